"""textloom: a Spark-native engine that audits and cleans text corpora."""

__version__ = "0.1.0"
