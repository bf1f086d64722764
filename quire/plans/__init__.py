"""Whole dataflows, from files to query results."""
