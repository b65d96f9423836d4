"""Whole analyses, and the adapters that make their inputs from other tables."""
