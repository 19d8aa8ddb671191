"""Official-statistics analytics on PySpark: semantic cubes, survey estimates, data quality and a freshness pulse."""

__version__ = "0.1.0"
