"""Readers of e-books, profiles and models, and writers of results."""
