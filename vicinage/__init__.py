"""Similarity search, its signatures and the analytics around them, as plain PySpark DataFrame plans."""
