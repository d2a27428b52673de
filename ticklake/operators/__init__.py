"""Operators on market tables; each takes and returns DataFrames."""
