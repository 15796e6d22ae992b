"""Spark-first analytics engine for catalogues of documents gathered from many sources."""
