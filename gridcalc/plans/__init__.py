"""Formulas as text, tokens and trees."""
