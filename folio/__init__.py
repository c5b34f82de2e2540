"""folio: refining paginated documents at scale with Spark DataFrames."""

__version__ = "0.1.0"
