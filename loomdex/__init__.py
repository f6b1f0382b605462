"""loomdex: a Spark-first context engine over source trees, text tables and event logs."""

__version__ = "0.1.0"
