"""Spark-native preparation of annotated text corpora and evaluation of text classifiers."""
