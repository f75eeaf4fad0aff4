"""Reading and writing corpora and results."""
