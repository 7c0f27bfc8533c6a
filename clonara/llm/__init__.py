"""Operators of a training-data pipeline on text, pages, vectors and conversations."""
