"""Relational operators on samples and levels."""
