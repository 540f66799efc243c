"""factlake: Spark-native analytics over quarterly XBRL financial-statement data."""

__version__ = "0.1.0"
