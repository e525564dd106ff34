"""Whole scans, and the registered queries."""

from __future__ import annotations

from .scan import Scan, ScanOptions, scan

__all__ = ["Scan", "ScanOptions", "scan"]
