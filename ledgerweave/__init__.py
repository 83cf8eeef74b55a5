"""Spark-native ledger and transaction-graph analytics."""
