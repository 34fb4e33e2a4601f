"""leafloom: Spark-first analytics for (page, schema, response) corpora."""

__version__ = "0.1.0"
