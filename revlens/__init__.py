"""Review analytics on Spark: ingest, clean, label, describe, trend and model app reviews."""

__version__ = "0.1.0"
