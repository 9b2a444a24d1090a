"""Operators of a training-data pipeline: ten independent modules and their queries."""
