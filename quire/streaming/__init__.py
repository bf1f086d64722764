"""Continuous intake of new books."""
