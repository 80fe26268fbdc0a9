"""Trawl: Spark-native evidence retrieval over conversational archives."""
