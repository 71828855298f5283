"""Column functions: vectors, text, chat summaries."""
