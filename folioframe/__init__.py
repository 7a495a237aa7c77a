"""Portfolio data on Spark: typed tables, merges, daily curation and analytics over DataFrames."""

__version__ = "0.1.0"
