"""Operators for preparing training data: one module each, with a query over the given tables."""
