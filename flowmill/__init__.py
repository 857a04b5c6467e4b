"""Market-flow analytics as Spark DataFrame operators."""
