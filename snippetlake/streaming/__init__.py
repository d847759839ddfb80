"""Continuous ingest."""

from .changes import change_stream  # noqa: F401
from .ingest import ingest_stream  # noqa: F401
