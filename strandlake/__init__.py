"""Spark jobs for translated sequence search."""
