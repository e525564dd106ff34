"""Inputs: file trees, tables of texts, earlier scans, and the store of earlier results."""

from __future__ import annotations

from .cache import cached, clear, probe, store
from .files import directories_of, file_info, read_tree, texts_of
from .scans import SCAN_SCHEMA, load_scans, merged_counts, normalised, section
from .tables import as_files

__all__ = ["SCAN_SCHEMA", "as_files", "cached", "clear", "directories_of", "file_info", "load_scans", "merged_counts", "normalised", "probe", "read_tree", "section", "store", "texts_of"]
