"""Scores 3-D point-cloud reconstructions against posed laser scans with Spark DataFrames."""
