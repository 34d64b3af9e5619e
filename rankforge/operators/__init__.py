"""Operators over tables of documents, chunks, queries, rankings and experiments."""
