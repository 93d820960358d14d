"""lexmill: analytics over law and ordinance corpora, written for Spark DataFrames."""

__version__ = "0.1.0"
