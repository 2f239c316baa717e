"""Stages over signals."""
