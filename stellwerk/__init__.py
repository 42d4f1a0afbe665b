"""Job-postings data processing on Apache Spark."""

__version__ = "0.1.0"
