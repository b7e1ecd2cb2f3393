"""tablewright: a Spark-native workbench for profiling, cleaning, querying and summarising tables."""

__version__ = "0.1.0"
