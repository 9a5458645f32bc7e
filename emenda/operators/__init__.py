"""Operators on DataFrames of documents, tokens, candidates and sequences."""
