"""Operators by kind; each takes and returns DataFrames."""
