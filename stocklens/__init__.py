"""Spark-native inventory, catalog and order analytics."""
