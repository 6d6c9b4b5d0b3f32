"""Spark-native analytics over media-asset libraries: catalog scans, ledgers, intervals, vectors, text."""
