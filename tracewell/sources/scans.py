"""Earlier scans in JSON: read with a fixed schema, rooted anew, merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree as tr

_MATCH = "struct<license_expression:string,license_expression_spdx:string,from_file:string,start_line:bigint,end_line:bigint,matcher:string,score:double,matched_length:bigint,match_coverage:double,rule_relevance:bigint,rule_identifier:string,matched_text:string>"


def _finding(value: str) -> str:
    return f"array<struct<{value}:string,start_line:bigint,end_line:bigint>>"


FILE = (
    "struct<path:string,type:string,name:string,base_name:string,extension:string,size:bigint,sha1:string,md5:string,sha256:string,mime_type:string,programming_language:string,is_source:boolean,is_generated:boolean,"
    f"license_detections:array<struct<license_expression:string,license_expression_spdx:string,identifier:string,matches:array<{_MATCH}>>>,copyrights:{_finding('copyright')},holders:{_finding('holder')},authors:{_finding('author')},"
    f"emails:{_finding('email')},urls:{_finding('url')},for_packages:array<string>,scan_errors:array<string>>"
)
PACKAGE = "struct<type:string,namespace:string,name:string,version:string,purl:string,package_uid:string,declared_license_expression:string,declared_license_expression_spdx:string,datafile_paths:array<string>,datasource_ids:array<string>>"
DEPENDENCY = "struct<purl:string,extracted_requirement:string,scope:string,is_runtime:boolean,is_optional:boolean,is_pinned:boolean,is_direct:boolean,dependency_uid:string,for_package_uid:string,datafile_path:string,datasource_id:string>"
SCAN_SCHEMA = (
    "headers array<struct<start_timestamp:string,end_timestamp:string,extra_data:struct<files_count:bigint,directories_count:bigint,excluded_count:bigint>>>, "
    f"packages array<{PACKAGE}>, dependencies array<{DEPENDENCY}>, license_detections array<struct<identifier:string,license_expression:string,detection_count:bigint>>, files array<{FILE}>"
)


def load_scans(spark: SparkSession, paths: list[str] | str, lines: bool = False) -> DataFrame:
    """A row for each document (or each line of JSON Lines) with ``scan`` (its file) and the sections; unknown fields are
    ignored, and sections that are missing are null."""
    raw = spark.read.schema(SCAN_SCHEMA).option("multiLine", str(not lines).lower()).json(paths)
    return raw.select(F.col("_metadata.file_path").alias("scan"), "*")


def section(scans: DataFrame, name: str) -> DataFrame:
    """scan and the fields of each row of a section, of all documents, with nothing left out."""
    return scans.select("scan", F.inline(name))


def merged_counts(scans: DataFrame) -> DataFrame:
    """One row: files_count, directories_count, size_count of the files, and the sum of excluded counts."""
    files = section(scans, "files")
    counted = tr.counters(files)
    excluded = scans.select(F.explode("headers").alias("h")).agg(F.coalesce(F.sum("h.extra_data.excluded_count"), F.lit(0)).alias("excluded_count"))
    return counted.crossJoin(excluded)  # one row each


def roots(scans: DataFrame) -> DataFrame:
    """scan, root: the shallowest, then shortest directory; a single file is its own root; else the common start."""
    files = section(scans, "files").select("scan", "path", (F.col("type") == "directory").alias("is_dir"))
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    summed = files.groupBy("scan").agg(
        F.min(F.when(F.col("is_dir"), F.struct(slashes.alias("a"), F.length("path").alias("b"), F.col("path").alias("c")))).alias("d"), F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.max("path").alias("last"),
    )
    a, b = F.split("first", "/"), F.split("last", "/")
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda k: F.when(F.slice(a, F.lit(1), k) == F.slice(b, F.lit(1), k), k))
    common = F.array_join(F.slice(a, F.lit(1), F.coalesce(F.array_max(same), F.lit(0))), "/")
    return summed.select("scan", F.coalesce("d.c", F.when(F.col("n") == 1, F.col("first")).otherwise(common)).alias("root"))


def normalised(scans: DataFrame, strip: bool = False, full: str | None = None) -> DataFrame:
    """The files of all scans with paths below each scan's root (``strip``), or absolute below a folder (``full``). The
    files that matches come from are changed alike."""
    files = section(scans, "files")
    if not strip and full is None:
        return files
    rooted = files.join(roots(scans), "scan")

    def change(p: Column) -> Column:
        return tr.strip_root(p, F.col("root")) if strip else tr.full_root(p, full)

    matches = lambda d: F.transform(d["matches"], lambda m: m.withField("from_file", F.when(m["from_file"].isNotNull(), change(m["from_file"]))))
    detections = F.transform("license_detections", lambda d: d.withField("matches", matches(d)))
    return rooted.withColumn("license_detections", detections).withColumn("path", change(F.col("path"))).drop("root")


def finding_table(files: DataFrame, name: str) -> DataFrame:
    """path and the fields of each finding of a column."""
    return files.select("path", F.inline(name))
