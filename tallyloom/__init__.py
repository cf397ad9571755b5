"""Spark-native consolidation of instrument results, plus training-data operators in ``llm``."""
