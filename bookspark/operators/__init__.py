"""bookspark.operators."""
