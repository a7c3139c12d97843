"""Incremental forms of the ledgers."""
