"""Sorting, runs, merging, partitioning and verification over records."""
