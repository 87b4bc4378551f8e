"""Sentences and sequents as values and as columns."""
