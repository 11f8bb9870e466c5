"""From query text to columns."""
