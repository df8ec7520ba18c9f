"""Newsloom: a Spark-native document lakehouse and retrieval engine."""
