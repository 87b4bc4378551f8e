"""Bases, axioms and commitments as DataFrames."""
