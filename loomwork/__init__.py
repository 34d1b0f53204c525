"""Spark-native analytics over prompts, recorded model responses and documents."""
