"""Whole jobs, the registered queries and their oracles."""
