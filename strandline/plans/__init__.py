"""Chunking plans that join the operators, and the queries of the entry module with their SQL."""
