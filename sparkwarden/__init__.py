"""Static security scanning over large text corpora, on PySpark DataFrames."""

__version__ = "0.1.0"
