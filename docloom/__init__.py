"""Spark-native analytics over large collections of long text documents."""
