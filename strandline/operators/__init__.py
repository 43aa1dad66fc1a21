"""Operators from DataFrames to DataFrames: graph, profile, boundaries, tables, turns, quality, retrieval, usage."""
