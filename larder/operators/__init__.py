"""Relational operators: each is a function of DataFrames returning DataFrames."""
