"""Spark jobs on aligned reads and intervals, and on training text."""
