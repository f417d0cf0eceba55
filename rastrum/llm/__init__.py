"""Operators for preparing training data, with the queries that register them."""
