"""Spark-native analytics over findings, states, graphs, ledgers and text corpora."""
