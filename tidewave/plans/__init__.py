"""Chains of stages as logical plans."""

from .pipeline import Pipeline  # noqa: F401
