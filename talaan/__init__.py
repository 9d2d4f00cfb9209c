"""talaan: a Spark-native engine for business listings, from raw records to scored, deduplicated leads."""

__version__ = "0.1.0"
