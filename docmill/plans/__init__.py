"""Registered queries and the pipelines made of the operators."""
