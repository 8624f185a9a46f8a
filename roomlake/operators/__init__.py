"""Operators: DataFrame in, DataFrame out, with explicit key, order and value columns."""
