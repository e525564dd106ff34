"""License and rule dimensions: the small tables that license operators join with.

``DEFAULT_RULES`` is a starter set; ``load_rules`` and ``load_licenses`` read larger ones from files with a header
between ``---`` lines, and ``write_index`` keeps both as Parquet.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name

KINDS = ("text", "notice", "reference", "tag", "intro", "clue")
RULE_SCHEMA = (
    "rid int, identifier string, license_expression string, kind string, text string, relevance smallint, "
    "minimum_coverage smallint, is_continuous boolean, is_false_positive boolean, is_from_license boolean, "
    "referenced_filenames array<string>, ignorable_copyrights array<string>, ignorable_holders array<string>, "
    "ignorable_authors array<string>, ignorable_urls array<string>, ignorable_emails array<string>"
)
LICENSE_SCHEMA = (
    "key string, name string, short_name string, category string, owner string, spdx_license_key string, "
    "other_spdx_license_keys array<string>, reference_urls array<string>, text string, notes string, is_deprecated boolean, "
    "replaced_by array<string>, minimum_coverage smallint, ignorable_copyrights array<string>, ignorable_holders array<string>, "
    "ignorable_authors array<string>, ignorable_urls array<string>, ignorable_emails array<string>"
)
SMALL_TOKENS, TINY_TOKENS = 15, 6

DEFAULT_RULES = [
    ("apache-2.0_ref.RULE", "apache-2.0", "notice", "Licensed under the Apache License, Version 2.0", 100),
    ("mit_ref.RULE", "mit", "notice", "Released under the MIT License", 100),
    ("gpl-3.0_ref.RULE", "gpl-3.0", "notice", "licensed under the GNU General Public License, version 3", 100),
    ("cc-by-nc-4.0_ref.RULE", "cc-by-nc-4.0", "notice", "Licensed under CC BY-NC 4.0", 100),
    ("bsd-new_ref.RULE", "bsd-new", "notice", "Redistribution and use in source and binary forms, with or without modification, are permitted", 95),
    ("mpl-2.0_ref.RULE", "mpl-2.0", "notice", "subject to the terms of the Mozilla Public License, v. 2.0", 100),
    ("mit_grant.RULE", "mit", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", 90),
    ("lgpl-2.1_ref.RULE", "lgpl-2.1", "notice", "GNU Lesser General Public License version 2.1", 100),
    ("proprietary_clue.RULE", "proprietary-license", "clue", "subject to the license agreement", 50),
]
DEFAULT_LICENSES = {
    "apache-2.0": ("Apache License 2.0", "Apache-2.0", "Permissive"),
    "bsd-new": ("BSD-3-Clause", "BSD-3-Clause", "Permissive"),
    "cc-by-nc-4.0": ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "Source-available"),
    "gpl-3.0": ("GNU GPL 3.0", "GPL-3.0-only", "Copyleft"),
    "lgpl-2.1": ("GNU LGPL 2.1", "LGPL-2.1-only", "Copyleft Limited"),
    "mit": ("MIT License", "MIT", "Permissive"),
    "mpl-2.0": ("Mozilla Public License 2.0", "MPL-2.0", "Copyleft Limited"),
    "proprietary-license": ("Proprietary License", None, "Proprietary Free"),
}
#: Words that mark license text; the others are too common to choose candidates by.
LEGALESE = frozenset(
    "apache lgpl gpl gnu mit mozilla bsd license licensed licence licenses licensing copyright redistribution redistribute "
    "permitted permission permissions granted warranty warranties liability herein hereby merchantability noninfringement "
    "sublicense rights agreement agreements contributor contributors patent royalty worldwide infringement terms cc".split()
)


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [(n, *r[:4], r[4], None, False, r[2] == "false-positive", False, *[[]] * 6) for n, r in enumerate(DEFAULT_RULES)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def default_licenses(spark: SparkSession) -> DataFrame:
    rows = [(k, n, n, c, None, s, [], [], "", None, False, [], None, *[[]] * 5) for k, (n, s, c) in DEFAULT_LICENSES.items()]
    return spark.createDataFrame(rows, LICENSE_SCHEMA)


def rule_kind(flags: dict[str, bool]) -> str | None:
    """The kind that ``is_license_<kind>`` flags name; two are an error, none is None."""
    found = [k for k in KINDS if flags.get(f"is_license_{k}")]
    if len(found) > 1:
        raise ValueError(f"a rule has one kind, not {', '.join(found)}")
    return found[0] if found else None


def rule_url(identifier: Column, is_from_license: Column, base: str) -> Column:
    """Rules made from licenses and rule files live in different folders below ``base``."""
    return F.concat(F.lit(base.rstrip("/")), F.when(is_from_license, "/licenses/").otherwise("/rules/"), identifier)


def header(text: str) -> object:
    """The value of a YAML header, by libyaml where PyYAML has it. Tabs, which libyaml takes in more places, go to PyYAML's own reader."""
    import yaml

    return yaml.load(text, Loader=yaml.SafeLoader if "\t" in text else getattr(yaml, "CSafeLoader", yaml.SafeLoader))


def _documents(df: DataFrame, schema: str, make) -> DataFrame:
    """Files (path, text) with a YAML header, as rows of a dimension; ``make`` turns stem, header and body into one.

    A file without a header or with a broken one gives no row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import yaml

        for batch in batches:
            rows = []
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = (text or "").lstrip("﻿").split("---\n", 2)
                if len(parts) < 3:
                    continue
                try:
                    head = header(parts[1]) or {}
                except yaml.YAMLError:
                    continue
                if isinstance(head, dict) and (row := make(name, head, parts[2])) is not None:
                    rows.append(row)
                if len(rows) >= 1000:  # many dicts at once are slow to keep and to convert
                    yield pa.RecordBatch.from_pylist(rows, schema=target)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    return df.select(file_name(F.col("path")).alias("name"), "text").mapInArrow(run, schema)


_IGNORABLE = ("ignorable_copyrights", "ignorable_holders", "ignorable_authors", "ignorable_urls", "ignorable_emails")


def load_rules(df: DataFrame) -> DataFrame:
    """Rule files. rid is a hash of the identifier, as no row knows the others."""

    def make(name: str, head: dict, body: str) -> dict | None:
        kind = rule_kind(head)
        false_positive = bool(head.get("is_false_positive"))
        if (kind is None and not false_positive) or not body.strip():
            return None
        relevance = int(head.get("relevance", 100))
        return {
            "rid": 0, "identifier": name, "license_expression": head.get("license_expression"), "kind": kind, "text": body.strip(),
            "relevance": relevance, "minimum_coverage": head.get("minimum_coverage"), "is_continuous": bool(head.get("is_continuous")),
            "is_false_positive": false_positive, "is_from_license": False,
            "referenced_filenames": head.get("referenced_filenames") or [], **{k: head.get(k) or [] for k in _IGNORABLE},
        }

    return _documents(df, RULE_SCHEMA, make).withColumn("rid", F.hash("identifier"))


def load_licenses(df: DataFrame) -> DataFrame:
    """License files: the key is the file's stem, names fall back on one another, URLs are trimmed and joined."""

    def make(name: str, head: dict, body: str) -> dict | None:
        key = name.rpartition(".")[0] or name
        deprecated = bool(head.get("is_deprecated"))
        if not body.strip() and not (deprecated or head.get("is_unknown") or head.get("is_generic")):
            return None
        urls = [*(head.get("text_urls") or []), *(head.get("other_urls") or []), head.get("osi_url"), head.get("faq_url"), head.get("homepage_url")]
        clean = list(dict.fromkeys(u.strip() for u in urls if u and u.strip()))
        return {
            "key": key, "name": head.get("name") or head.get("short_name") or key, "short_name": head.get("short_name") or head.get("name") or key,
            "category": head.get("category"), "owner": head.get("owner"), "spdx_license_key": (head.get("spdx_license_key") or "").strip() or None,
            "other_spdx_license_keys": head.get("other_spdx_license_keys") or [], "reference_urls": clean, "text": body,
            "notes": (head.get("notes") or "").strip() or None, "is_deprecated": deprecated, "replaced_by": head.get("replaced_by") or [],
            "minimum_coverage": head.get("minimum_coverage"), **{k: head.get(k) or [] for k in _IGNORABLE},
        }

    return _documents(df, LICENSE_SCHEMA, make)


def license_rules(licenses: DataFrame) -> DataFrame:
    """Rules that the license texts themselves make."""
    empty = F.array().cast("array<string>")
    return licenses.where(F.trim("text") != "").select(
        F.hash(F.concat("key", F.lit(".LICENSE"))).alias("rid"), F.concat("key", F.lit(".LICENSE")).alias("identifier"),
        F.col("key").alias("license_expression"), F.lit("text").alias("kind"), "text", F.lit(100).cast("smallint").alias("relevance"),
        "minimum_coverage", F.lit(False).alias("is_continuous"), F.lit(False).alias("is_false_positive"), F.lit(True).alias("is_from_license"),
        empty.alias("referenced_filenames"), *_IGNORABLE,
    )


def spdx_names(licenses: DataFrame) -> dict[str, str | None]:
    """License key to SPDX key. As many rows as licenses, a dimension of bounded size."""
    return {r[0]: r[1] for r in licenses.select("key", "spdx_license_key").collect()}


def write_index(rules: DataFrame, licenses: DataFrame, path: str) -> None:
    """Each is made once and written by all tasks; an order over all files would take a first pass for its borders, and one file a single task."""
    rules.sortWithinPartitions("identifier").write.mode("overwrite").parquet(f"{path}/rules")
    licenses.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/licenses")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(RULE_SCHEMA).parquet(f"{path}/rules"), spark.read.schema(LICENSE_SCHEMA).parquet(f"{path}/licenses")
