"""strandframe: alignment analytics and data preparation as plain Spark jobs."""

__version__ = "0.1.0"
