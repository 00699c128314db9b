"""Few-shot classification over stored embeddings, written for Spark DataFrames."""

__version__ = "0.1.0"
