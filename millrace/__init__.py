"""Millrace: a Spark-native engine for curating, gating, retrieving and scoring text corpora."""
