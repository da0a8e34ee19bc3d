"""lumika: a Spark-native analytics engine for photo catalogs."""

__version__ = "0.1.0"
