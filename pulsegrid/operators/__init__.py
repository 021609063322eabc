"""Operators over tables: each takes and returns DataFrames."""
