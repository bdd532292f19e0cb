"""Operators for text that models are trained on."""
