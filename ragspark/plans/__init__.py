"""Queries put together from the operators, and their SQL."""
