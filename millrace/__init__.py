"""A Spark-first analytics engine: relational, full-text, spatial, vector, row-expiry and upsert operators."""

__version__ = "0.1.0"
