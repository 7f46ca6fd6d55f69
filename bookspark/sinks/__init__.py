"""bookspark.sinks."""
