"""Temporal reachability analytics expressed as Spark jobs."""
