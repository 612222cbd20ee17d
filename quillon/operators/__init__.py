"""Relational operators over sparse feature vectors."""
