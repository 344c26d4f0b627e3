"""gridloom: a Spark-native engine that turns web tables into knowledge triples."""

__version__ = "0.1.0"
