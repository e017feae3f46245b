"""marginalia: Spark jobs for checkable reading of text at scale."""

__version__ = "0.1.0"
