"""Workload sources."""
