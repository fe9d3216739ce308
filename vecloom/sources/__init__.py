"""Databases of collections on Parquet, and exchange formats."""
