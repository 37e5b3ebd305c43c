"""Operators of a training-data pipeline over document, embedding and label tables."""
