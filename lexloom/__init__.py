"""Extractive text analytics on Spark: scoring, selection, fusion and evaluation of sentences."""
