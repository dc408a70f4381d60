"""Change-data-capture analytics and training-data preparation on plain Apache Spark."""

__version__ = "0.1.0"
