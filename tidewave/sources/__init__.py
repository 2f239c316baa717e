"""Signals as relations, and their layouts."""

from .signal import Signal, deinterleave, get_channel, interleave, planar_to_long  # noqa: F401
