"""Whole-column functions: text, dates, amounts, identifiers, geometry, JSON, vectors."""
