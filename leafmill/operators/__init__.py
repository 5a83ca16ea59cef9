"""Operators over catalogs: DataFrames with a row for each file."""
