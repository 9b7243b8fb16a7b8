"""Candle analytics on Spark: bars, windows, retrieval, evaluation, event studies."""
