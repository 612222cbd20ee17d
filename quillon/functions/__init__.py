"""Scalar functions over sparse vectors, strings and keyed random numbers."""
