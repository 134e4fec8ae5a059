"""Operators of a training-data pipeline, each with its query in ``queries``."""
