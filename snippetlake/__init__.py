"""snippetlake: search and near-duplicate detection over source code, on Spark."""

__version__ = "0.1.0"
