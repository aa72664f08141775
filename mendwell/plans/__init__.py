"""Queries over the benchmark tables, composed from the operators."""
