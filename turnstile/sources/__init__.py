"""Bases and statements from files, and back."""
