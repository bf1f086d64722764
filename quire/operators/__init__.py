"""Operators over DataFrames of books, documents, blocks and units."""
