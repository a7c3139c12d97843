"""Relational operators over candidate, oracle and count tables."""
