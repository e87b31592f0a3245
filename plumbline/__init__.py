"""Plumbline: exact analytics on very large point clouds, written for Spark's DataFrame engine."""
