"""Structure-preserving chunking and retrieval preparation on Spark DataFrames."""
