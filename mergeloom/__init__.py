"""Spark-native byte-pair-encoding engine: segment, count, train, encode, decode, export."""
