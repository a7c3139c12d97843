"""Registered queries: each is a plan over the operators, beside equivalent SQL."""
