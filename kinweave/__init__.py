"""Kinweave: genealogy bundles and training-data preparation as Spark DataFrames."""
