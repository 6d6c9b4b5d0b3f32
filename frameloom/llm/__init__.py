"""Operators of a training-data pipeline over texts and vectors."""
