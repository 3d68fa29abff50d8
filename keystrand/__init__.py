"""keystrand: record sorting, merging, partitioning and verification as Spark plans."""

__version__ = "0.1.0"
