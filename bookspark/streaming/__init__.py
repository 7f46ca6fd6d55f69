"""bookspark.streaming."""
