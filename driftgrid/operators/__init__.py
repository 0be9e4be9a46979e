"""Operators: DataFrame in, DataFrame out; key and value columns are parameters."""
