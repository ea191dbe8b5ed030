"""Whole preparation jobs built from the operators."""
