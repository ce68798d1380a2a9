"""Capture analytics on Spark: scans, keyed upserts, reports and text cleaning as DataFrame operators."""

__version__ = "0.1.0"
