"""Registered queries with their SQL checks, one module per family."""
