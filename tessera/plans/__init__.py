"""Pipelines of several operators."""
