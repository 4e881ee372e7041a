"""Spark plans."""
