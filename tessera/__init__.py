"""Spark-first hybrid document search: lexical, vector and fused ranking on DataFrames."""
