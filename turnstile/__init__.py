"""A PySpark engine for nonmonotonic sequent reasoning over tables."""

__version__ = "0.1.0"
