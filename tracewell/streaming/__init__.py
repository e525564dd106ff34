"""Scans of files as they arrive."""

from __future__ import annotations

from .scan import incoming_files, incoming_texts, start, windowed_tallies

__all__ = ["incoming_files", "incoming_texts", "start", "windowed_tallies"]
