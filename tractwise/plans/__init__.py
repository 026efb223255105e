"""Assembled batches built from the operators."""
