"""Operators of a training-data pipeline: de-duplication, search, mixing, scoring and packing."""
