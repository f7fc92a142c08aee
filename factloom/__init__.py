"""factloom: relational fact mining over source code and text, on Spark."""

__version__ = "0.1.0"
