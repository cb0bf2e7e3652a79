"""Spark-native analytics over price bars: ingest, resample, detect, search, simulate, measure."""
