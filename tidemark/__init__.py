"""Realised-volatility analytics on Spark: bars in, forecasts and their evaluation out."""
