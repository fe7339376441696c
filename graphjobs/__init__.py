"""Spark jobs for building, cleaning, checking and querying knowledge graphs."""
