"""Whole analyses composed of operators, and the query catalog."""
