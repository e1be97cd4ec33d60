"""Operators on near-optimal sets."""
