"""Column builders: vectors, boxes, text and ranks."""
