"""Loomwright: a PySpark-native document-intelligence and analytics engine."""
