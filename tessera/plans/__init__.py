"""Registered queries over the operators."""
