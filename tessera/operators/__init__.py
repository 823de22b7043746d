"""Mesh operators: relational where a fixed number of joins does, iterated or per-mesh kernels else."""
