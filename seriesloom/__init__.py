"""seriesloom: a time-series query engine and series-cleaning library on Spark DataFrames."""

__version__ = "0.1.0"
