"""Operators for preparing training data, at most one module for each; nothing else in the library imports them."""
