"""Whole jobs built from the operators, and the queries registered for checking."""
