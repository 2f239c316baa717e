"""Stateful stages over streams."""
