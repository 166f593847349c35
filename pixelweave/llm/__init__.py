"""Operators for large training-data corpora, as Spark jobs over tables of documents or pages."""
