"""trailmark: trajectory scoring and data processing at dataset scale on Spark."""

__version__ = "0.1.0"
