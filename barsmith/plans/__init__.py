"""Whole analyses made of operators, and the queries of the entry point."""
