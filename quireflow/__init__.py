"""Quireflow: long documents to retrieval-augmented summarisation data on Spark."""
