"""Clause analytics on Spark."""
