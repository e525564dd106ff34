"""Readers of package manifests, and the table of rows that they make of files."""

from __future__ import annotations

from . import archives, dotnet, javascript, jvm, linux, misc, mobile, native, python, recognisers, ruby  # noqa: F401  they fill READERS
from .base import PACKAGE_SCHEMA, READERS, Reader
from .table import matching_readers, package_data, readers_table

__all__ = ["PACKAGE_SCHEMA", "READERS", "Reader", "matching_readers", "package_data", "readers_table"]
