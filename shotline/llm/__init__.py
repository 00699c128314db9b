"""Operators of a training-data pipeline: de-duplication, quality, language, mixing, packing, search."""
