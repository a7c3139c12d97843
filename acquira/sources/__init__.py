"""Readers and writers of the relations."""
