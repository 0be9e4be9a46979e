"""Spark-native analytics for gridded ensembles and time series."""
