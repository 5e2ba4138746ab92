"""Spark-native scene analytics: catalog, bands, tiles, runs, ensembles, vectors and evaluation."""
