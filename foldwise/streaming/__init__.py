"""streaming of foldwise."""
