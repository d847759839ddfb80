"""Inputs (manifest, source files, parse trees) and the stored vector table."""
