"""Whole searches put together from the operators."""
