"""quirework: catalogue quality and corpus preparation on Spark."""

__version__ = "0.1.0"
