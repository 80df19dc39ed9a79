"""Spark-native analytics over OHLCV series, deliveries, trades and texts."""
