"""Readers, writers and views over the driver's base tables."""
