"""Iterative algorithms: driver loops over declarative steps."""
