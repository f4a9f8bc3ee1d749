"""Prompt plans, retrieval variants, and the registered queries."""
