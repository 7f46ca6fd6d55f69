"""bookspark.plans."""
