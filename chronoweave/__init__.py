"""chronoweave: temporal-graph analytics and training-data preparation as PySpark DataFrames."""

__version__ = "0.1.0"
