"""The report: files with their findings nested, packages, dependencies, detections; JSON, JSON Lines, YAML, CSV."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import document, fixed, items, of_rows

TOOL, FORMAT_VERSION = "tracewell", "4.0.0"
NOTICE = 'Provided on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. It is no legal advice.'
HEADER = "start_timestamp string, end_timestamp string, duration double, tool_name string, output_format_version string, notice string, errors array<string>, files_count bigint, directories_count bigint, excluded_count bigint"


@dataclass
class Report:
    """Frames of a scan. ``files``: one row for each path, with arrays of structs for findings (see ``nest_files``).

    Other sections are left out of documents where they are None."""

    spark: SparkSession
    files: DataFrame
    header: dict = field(default_factory=dict)
    packages: DataFrame | None = None
    dependencies: DataFrame | None = None
    license_detections: DataFrame | None = None
    summary: DataFrame | None = None
    tallies: DataFrame | None = None
    tallies_of_key_files: DataFrame | None = None
    tallies_by_facet: DataFrame | None = None
    license_references: DataFrame | None = None
    license_rule_references: DataFrame | None = None

    def header_frame(self) -> DataFrame:
        base = {"tool_name": TOOL, "output_format_version": FORMAT_VERSION, "notice": NOTICE, "errors": []}
        kinds = [c.strip().split(" ", 1) for c in HEADER.split(", ")]
        row = tuple((base | self.header).get(name) for name, _ in kinds)
        return self.spark.createDataFrame([row], HEADER)


#: Sections in the order of documents.
SECTIONS = ("summary", "tallies", "tallies_of_key_files", "tallies_by_facet", "packages", "dependencies", "license_detections", "license_references", "license_rule_references")
ONE_ROW = ("summary",)


def nest_files(files: DataFrame, facts: dict[str, DataFrame], path: str = "path") -> DataFrame:
    """Files with one array column for each fact table (its rows, sorted, as structs); empty where there are none.

    Each table is grouped by path before it is joined, so a join moves one row for a path."""
    out = files
    for name, rows in facts.items():
        columns = [c for c in rows.columns if c != path]
        order = [c for c in ("start_line", "end_line") if c in columns]
        shown = F.struct(*columns)
        place = F.struct(*[F.col(c) for c in order], F.to_json(shown).alias("_j"))
        compare = lambda a, b: F.when(a["_k"] < b["_k"], -1).when(a["_k"] > b["_k"], 1).otherwise(0)
        held = rows.groupBy(F.col(path).alias("_p")).agg(F.array_sort(F.collect_list(F.struct(place.alias("_k"), shown.alias("_v"))), compare).alias("_a"))
        empty = F.filter(F.array(F.lit(None).cast(dict_type(rows, columns))), lambda x: x.isNotNull())
        joined = out.join(held, F.col(path) == F.col("_p"), "left")
        out = joined.withColumn(name, F.coalesce(F.col("_a._v"), empty)).drop("_p", "_a")
    return out


def dict_type(rows: DataFrame, columns: list[str]) -> str:
    return rows.select(F.struct(*columns).alias("s")).schema["s"].dataType.simpleString()


def as_json(df: DataFrame, pretty: bool = False, nulls: bool = False) -> Column:
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": str(not nulls).lower(), "pretty": str(pretty).lower()})


def _keys(df: DataFrame) -> Column:
    """What a section's rows are ordered by: path or the first columns that name a row."""
    named = [c for c in ("path", "purl", "name", "identifier", "facet_pos", "attribute", "value", "key", "rid", "datafile_path") if c in df.columns]
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in named]) if named else F.lit("")


def json_lines(report: Report) -> DataFrame:
    """A line for the header, one for each section that is there, and one for each file, by path."""
    wrap = lambda name, body: F.concat(F.lit(f'{{"{name}":'), body, F.lit("}"))
    head = report.header_frame()
    parts = [of_rows(head, 0, F.lit(""), wrap("headers", F.concat(F.lit("["), as_json(head), F.lit("]"))))]
    for n, name in enumerate(SECTIONS, 1):
        df = getattr(report, name)
        if df is None:
            continue
        if name in ONE_ROW:
            parts.append(of_rows(df, n, F.lit(""), wrap(name, as_json(df))))
        else:
            parts.append(of_rows(df, n, _keys(df), wrap(name, F.concat(F.lit("["), as_json(df), F.lit("]")))))
    files = report.files
    parts.append(of_rows(files, 90, F.col("path"), wrap("files", F.concat(F.lit("["), as_json(files, nulls=True), F.lit("]")))))
    return document(*parts)


def json_document(report: Report, pretty: bool = False) -> DataFrame:
    """One JSON object over many lines; the part files, joined, are the document."""
    spark = report.spark
    head = report.header_frame()
    parts = [fixed(spark, 0, '{"headers": ['), of_rows(head, 1, F.lit(""), as_json(head, pretty)), fixed(spark, 2, "]")]
    at = 10
    for name in SECTIONS:
        df = getattr(report, name)
        if df is None and name not in ("packages", "dependencies", "license_references", "license_rule_references"):
            continue
        if name in ONE_ROW:
            parts += [fixed(spark, at, f', "{name}":'), of_rows(df, at + 1, F.lit(""), as_json(df, pretty))]
        else:
            parts.append(fixed(spark, at, f', "{name}": ['))
            if df is not None:
                parts.append(items(df, at + 1, _keys(df), as_json(df, pretty)))
            parts.append(fixed(spark, at + 2, "]"))
        at += 10
    parts += [fixed(spark, 900, ', "files": ['), items(report.files, 901, F.col("path"), as_json(report.files, pretty, nulls=True)), fixed(spark, 902, "]}")]
    return document(*parts)


def yaml_document(report: Report) -> DataFrame:
    """The same sections as YAML: each row is turned where it is, so that no task holds more than a row."""
    spark = report.spark

    def listed(df: DataFrame, section: int, key: Column) -> DataFrame:
        rows = df.select(F.coalesce(key.cast("string"), F.lit("")).alias("key"), as_json(df, nulls=True).alias("j"))

        def run(batches):
            import json

            import yaml

            for batch in batches:
                shown = []
                for j in batch.column(1).to_pylist():
                    body = yaml.safe_dump(json.loads(j), sort_keys=False, allow_unicode=True, default_flow_style=False, width=1_000_000).rstrip("\n").split("\n")
                    shown.append("\n".join(("  - " if k == 0 else "    ") + s for k, s in enumerate(body)))
                yield pa.RecordBatch.from_arrays([pa.array([section] * batch.num_rows, pa.int32()), batch.column(0), pa.array(shown, pa.string())], ["section", "key", "value"])

        return rows.mapInArrow(run, "section int, key string, value string")

    parts = [fixed(spark, 0, "headers:"), listed(report.header_frame(), 1, F.lit(""))]
    at = 10
    for name in SECTIONS:
        df = getattr(report, name)
        if df is not None:
            parts += [fixed(spark, at, f"{name}:"), listed(df, at + 1, _keys(df))]
        at += 10
    return document(*parts, fixed(spark, 900, "files:"), listed(report.files, 901, F.col("path")))


# CSV ---------------------------------------------------------------------------------------------------------------

_FACTS = (("copyrights", "copyright", "copyright"), ("holders", "holder", "holder"), ("authors", "author", "author"), ("emails", "email", "email"), ("urls", "url", "url"))


def _csv_path(files: DataFrame) -> Column:
    bare = F.regexp_replace("path", "^/+", "")
    return F.when((F.col("type") == "directory") & ~bare.endswith("/"), F.concat(bare, F.lit("/"))).otherwise(bare) if "type" in files.columns else bare


def _flat(value: Column, kind: str) -> Column:
    if kind.startswith("array<string"):
        return F.array_join(value, "\n")
    if kind.startswith(("array", "map", "struct")):
        return F.to_json(value)
    return value.cast("string")


def csv_table(report: Report) -> DataFrame:
    """Long table: a row for each file, license match, copyright, holder, author, e-mail, URL and manifest.

    Columns come in groups: info, license, findings, package. Versions begin with ``v ``."""
    files = report.files.withColumn("_path", _csv_path(report.files))
    kinds = dict(report.files.dtypes)
    info = [c for c in ("mime_type", "name", "scan_errors", "sha1", "size", "type") if c in kinds]
    out = [files.select(F.lit("info").alias("kind"), F.col("_path").alias("path"), *[_flat(F.col(c), kinds[c]).alias(c) for c in info])]
    if "license_detections" in kinds:
        found = files.select("_path", F.inline("license_detections")).select("_path", F.col("license_expression").alias("_whole"), F.inline("matches"))
        out.append(found.select(
            F.lit("license").alias("kind"), F.col("_path").alias("path"), F.col("_whole").alias("license_expression"), F.col("license_expression").alias("license_match__license_expression"),
            F.format_string("%.2f", F.col("score").cast("double")).alias("license_match__score"), F.col("rid").cast("string").alias("license_match__rule_identifier"),
            F.col("start_line").cast("string").alias("start_line"), F.col("end_line").cast("string").alias("end_line"),
        ))
    for column, kind, value in _FACTS:
        if column in kinds:
            found = files.select("_path", F.inline(column))
            out.append(found.select(F.lit(kind).alias("kind"), F.col("_path").alias("path"), F.col(value), F.col("start_line").cast("string").alias("start_line"), F.col("end_line").cast("string").alias("end_line")))
    if "package_data" in kinds:
        rows = files.select("_path", F.inline("package_data"))
        own = [(c, t) for c, t in rows.dtypes if c != "_path"]
        v = F.col("version")
        version = F.when((v == "") | F.lower(v).startswith("v"), v).otherwise(F.concat(F.lit("v "), v))
        out.append(rows.select(F.lit("package_data").alias("kind"), F.col("_path").alias("path"), *[(version if c == "version" else _flat(F.col(c), t)).alias(f"package__{c}") for c, t in sorted(own)]))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
    return whole.select(*[F.coalesce(c, F.lit("")).alias(c) for c in whole.columns])


def write_csv(report: Report, path: str, single: bool = False) -> None:
    """Sorted by path; within a path in the order of the groups."""
    order = F.array_position(F.array(*[F.lit(k) for k in ("info", "license", *(k for _, k, _ in _FACTS), "package_data")]), F.col("kind"))
    rows = csv_table(report).orderBy("path", order, "start_line")
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
