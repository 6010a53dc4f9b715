"""Spark-native engine for citation-ready evidence retrieval over long documents."""
