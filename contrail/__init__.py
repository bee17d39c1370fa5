"""Spark jobs that turn aircraft position snapshots into flights and fleet statistics."""
