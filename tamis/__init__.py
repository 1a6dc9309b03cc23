"""Corpus trust, retrieval and audit operators on Apache Spark DataFrames."""
