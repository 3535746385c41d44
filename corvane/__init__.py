"""Retrieval, graph and training-data operators, declared as Spark plans."""
