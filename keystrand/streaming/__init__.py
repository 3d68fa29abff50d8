"""Continuous intake of records as sorted runs."""
