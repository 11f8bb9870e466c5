"""Searching, ranking and refreshing catalogs."""
