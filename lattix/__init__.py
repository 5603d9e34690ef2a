"""Spark-native knowledge-graph analytics: typed entity and relation tables, queried as DataFrame plans."""
