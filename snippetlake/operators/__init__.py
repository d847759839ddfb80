"""Relational and vector operators; each takes and returns DataFrames."""
