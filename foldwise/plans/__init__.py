"""plans of foldwise."""
