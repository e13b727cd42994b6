"""Spark-native document recommendation: DataFrame in, DataFrame out."""
