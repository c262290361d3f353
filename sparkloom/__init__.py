"""Relational equi-joins on Spark as named strategies, their workloads, partitioning, padding and sealing."""
