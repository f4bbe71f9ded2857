"""Typed record analytics on Spark: catalog, query builder and maintained views over DataFrames."""
