"""Operators on keyed logs. Each takes DataFrames and returns a lazy DataFrame."""
