"""Belief analytics over large tables, expressed as Spark jobs."""
