"""bookspark.sources."""
