"""Operators for preparing training data: filters, near-copies, tokens, models."""
