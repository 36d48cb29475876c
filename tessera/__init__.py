"""Sensor analytics on Spark: decode, align, transform, aggregate, search and estimate over DataFrames."""
