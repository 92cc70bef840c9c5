"""Operators over files, lines, facts and findings; each takes and returns DataFrames."""
