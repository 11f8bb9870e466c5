"""Continuous forms: refreshes and matches over arriving path lists."""
