"""Joins whose S side arrives in chunks."""
