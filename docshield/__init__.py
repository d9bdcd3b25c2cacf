"""docshield: document privacy and guarded retrieval as Spark DataFrame jobs."""

__version__ = "0.1.0"
