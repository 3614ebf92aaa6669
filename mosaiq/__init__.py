"""mosaiq: indexed-graphics and packed-binary analytics on Spark DataFrames."""

__version__ = "0.1.0"
