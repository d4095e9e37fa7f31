"""Turnloom: a Spark-native engine for multi-track dialogue timelines."""

__version__ = "0.1.0"
