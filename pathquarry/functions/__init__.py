"""Column functions on raw-byte paths."""
