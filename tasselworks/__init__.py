"""Spark-native curation and analytics engine for labelled corpora."""
