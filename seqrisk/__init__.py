"""Event-sequence compression and risk-model comparison as Spark DataFrame operators."""
