"""notefathom: analytics over collections of linked text notes, written for Spark."""

__version__ = "0.1.0"
