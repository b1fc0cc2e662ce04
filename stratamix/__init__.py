"""stratamix: mixture-model clustering of large numeric tables, expressed as Spark DataFrames."""

__version__ = "0.1.0"
