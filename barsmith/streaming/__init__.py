"""Bars from a stream of ticks."""
