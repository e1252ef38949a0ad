"""functions of foldwise."""
