"""A Spark-native engine for searching and analysing catalogs of file paths."""
