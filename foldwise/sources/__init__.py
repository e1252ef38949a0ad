"""sources of foldwise."""
