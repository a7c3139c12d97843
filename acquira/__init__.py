"""Acquisition analytics on Spark."""
