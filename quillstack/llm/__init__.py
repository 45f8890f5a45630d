"""Operators for preparing training data: scans, filters, deduplication, formats and packing."""
