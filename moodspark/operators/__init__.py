"""Relational operators: DataFrame in, DataFrame or Columns out."""
