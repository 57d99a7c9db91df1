"""The operators: DataFrame in, DataFrame out."""
