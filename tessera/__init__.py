"""Spark-first analytics over corpora of triangle surface meshes."""
