"""Operators of a training-data pipeline: scoring, de-duplication, counting, classing, mixing, packing and search."""
