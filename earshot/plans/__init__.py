"""Whole jobs: evaluation inputs derived from tables, registered queries, batch runs."""
