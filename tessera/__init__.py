"""Tessera: retrieval, knowledge-graph and model-analysis operators on Spark DataFrames."""
