"""operators of foldwise."""
