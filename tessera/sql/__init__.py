"""Presto SQL as an entry: text is translated and then planned by Spark."""
