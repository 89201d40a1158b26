"""Relational operators on tracking tables: DataFrame in, DataFrame out."""
