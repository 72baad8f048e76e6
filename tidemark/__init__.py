"""Trace, retrieval-quality and temporal-graph analytics as Spark DataFrame operators."""
