"""Provenance graphs and lexical retrieval on Spark DataFrames."""
