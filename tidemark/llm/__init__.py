"""Operators on texts. Nothing outside this folder imports it."""
