"""Batch retrieval, entity graph and retrieval evaluation on PySpark DataFrames."""
