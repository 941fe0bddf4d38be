"""Operators on DataFrames: ``signal`` on one row a sample, ``reads`` on one row a read."""
