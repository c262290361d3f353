"""Relation helpers and scalar functions."""
