"""Operators over trial tables: each takes DataFrames and returns a lazy DataFrame."""
