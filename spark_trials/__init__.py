"""Spark jobs for the analysis of randomized message experiments, and for the preparation of training text."""
