"""Operators that turn a raw text corpus into training data. Nothing outside this folder imports it."""
