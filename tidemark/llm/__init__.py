"""Operators for building training corpora: scans, filters, near-duplicate joins, mixing and output."""
