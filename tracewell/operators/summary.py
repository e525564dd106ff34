"""Classification, facets, tallies, clarity score and summary over files and their facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import matches_path
from ..functions.text import file_name
from .tree import depth, parent

FACETS = ("core", "dev", "tests", "docs", "data", "examples")
_LEGAL = r"(?i)^(?:copying|copyright|licen[cs]e|notice|eula|legal|patents?|unlicense|ofl)(?:$|[^a-z].*|s(?:$|[^a-z].*))|(?:^|[._-])(?:licen[cs]e|copying|notice|copyright)(?:\.[a-z]+)?$"
_README = r"(?i)^(?:read[._-]?me|readme)(?:$|[^a-z].*)|^.*[._-]readme(?:\.[a-z]+)?$"
_COMMUNITY = r"(?i)^(?:change(?:s|log)|history|code[-_]of[-_]conduct|contribut(?:ing|ors)|security|roadmap|authors|governance|maintainers|funding)(?:\.[a-z]+)?$"
_MANIFESTS = r"(?i)^(?:package\.json|composer\.json|cargo\.toml|setup\.(?:py|cfg)|pyproject\.toml|pom\.xml|go\.mod|gemfile|.*\.gemspec|.*\.podspec|pubspec\.yaml|build\.gradle(?:\.kts)?|.*\.csproj|.*\.nuspec|bower\.json|haxelib\.json|chart\.yaml|.*\.cabal|vcpkg\.json|deno\.jsonc?|metadata\.(?:rb|json)|dockerfile|conanfile\.(?:py|txt)|.*\.spec|description|meta\.(?:json|yml|yaml))$"


def classify(files: DataFrame, root: str = "", packages: DataFrame | None = None, referenced: DataFrame | None = None, path: str = "path") -> DataFrame:
    """path, is_legal, is_readme, is_manifest, is_community, is_top_level, is_key_file.

    A file is at the top level if its directory is the root, or a package's root. A key file is legal, readme or manifest
    at the top level and no community file; a legal file deeper down is one if a package refers to it."""
    p, name = F.col(path), file_name(F.col(path))
    flagged = files.select(
        path, name.rlike(_LEGAL).alias("is_legal"), name.rlike(_README).alias("is_readme"), name.rlike(_MANIFESTS).alias("is_manifest"),
        (name.rlike(_COMMUNITY) & ~name.rlike(_LEGAL)).alias("is_community"), (parent(p) == root.strip("/")).alias("_top"),
    )
    if packages is not None:
        tops = packages.select(F.explode("datafile_paths").alias("_d")).select(parent(F.col("_d")).alias("_dir")).distinct()
        flagged = flagged.join(tops.withColumn("_is", F.lit(True)), parent(F.col(path)) == F.col("_dir"), "left").withColumn("_top", F.col("_top") | F.coalesce("_is", F.lit(False))).drop("_is", "_dir")
    key = F.col("_top") & (F.col("is_legal") | F.col("is_readme") | F.col("is_manifest")) & ~F.col("is_community")
    if referenced is not None:
        names = referenced.select(F.col(path).alias("_r")).distinct().withColumn("_ref", F.lit(True))
        flagged = flagged.join(names, F.col(path) == F.col("_r"), "left").withColumn("_ref", F.coalesce("_ref", F.lit(False)))
        key = key | (F.col("is_legal") & F.col("_ref"))
    return flagged.select(path, "is_legal", "is_readme", "is_manifest", "is_community", F.col("_top").alias("is_top_level"), key.alias("is_key_file"))


def common_top(files: DataFrame, path: str = "path") -> DataFrame:
    """One row, top: the least depth of a file."""
    return files.agg(F.min(depth(F.col(path))).alias("top"))


def facets(files: DataFrame, rules: list[tuple[str, str]], path: str = "path", is_dir: str | None = None) -> DataFrame:
    """path, facets: each facet whose pattern selects the file, once and in the fixed order; ``core`` if none does.
    Directories have none."""
    own = [F.when(reduce(lambda a, b: a | b, [matches_path(F.col(path), [p]) for g, p in rules if g == f], F.lit(False)), F.lit(f)) for f in FACETS]
    found = F.array_compact(F.array(*own))
    named = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("core")))
    return files.select(path, (F.when(F.col(is_dir), F.array().cast("array<string>")).otherwise(named) if is_dir else named).alias("facets"))


def tally(facts: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Rows by value, the most frequent first where order is kept; a null value says that nothing was found."""
    return facts.groupBy(*by, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def tallies(files: DataFrame, facts: dict[str, tuple[DataFrame, str]], path: str = "path") -> DataFrame:
    """attribute, value, count over all files; files without a fact count under null."""
    out = []
    for name, (rows, value) in facts.items():
        held = rows.select(F.col(path).alias("_p"), F.col(value).cast("string").alias("_v"))
        joined = files.select(path).join(held, F.col(path) == F.col("_p"), "left")
        out.append(joined.groupBy(F.col("_v").alias("value")).agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("attribute"), "value", "count"))
    return reduce(DataFrame.unionByName, out)


def tallies_by_facet(files: DataFrame, with_facets: DataFrame, facts: dict[str, tuple[DataFrame, str]], path: str = "path") -> DataFrame:
    """facet, attribute, value, count without null values. Facets with nothing stay with a null attribute."""
    opened = with_facets.select(F.col(path).alias("_q"), F.explode("facets").alias("facet"))
    counted = reduce(DataFrame.unionByName, [
        rows.select(F.col(path).alias("_p"), F.col(value).cast("string").alias("value")).where("value IS NOT NULL").join(opened, F.col("_p") == F.col("_q"))
        .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count")).select("facet", F.lit(name).alias("attribute"), "value", "count")
        for name, (rows, value) in facts.items()
    ])
    order = files.sparkSession.createDataFrame([(f, n) for n, f in enumerate(FACETS)], "facet string, facet_pos int")
    return F.broadcast(order).join(counted, "facet", "left").select("facet_pos", "facet", "attribute", "value", F.coalesce("count", F.lit(0)).alias("count"))


def key_file_tallies(flags: DataFrame, facts: dict[str, tuple[DataFrame, str]], path: str = "path") -> DataFrame:
    return tallies(flags.where("is_key_file"), facts, path)


def detailed_tallies(facts: dict[str, tuple[DataFrame, str]], path: str = "path") -> DataFrame:
    """path, attribute, value, count."""
    return reduce(DataFrame.unionByName, [tally(rows.select(path, value), value, [path]).select(path, F.lit(name).alias("attribute"), F.col("value").cast("string").alias("value"), "count") for name, (rows, value) in facts.items()])


#: Parts of the clarity score.
CLARITY = {"declared_license": 40, "identification_precision": 40, "has_license_text": 10, "declared_copyrights": 10}
CLARITY_PENALTY = {"conflicting_license_categories": 20, "ambiguous_compound_licensing": 10}


def clarity(flags: DataFrame, licenses: DataFrame, copyrights: DataFrame, categories: DataFrame | None = None, path: str = "path") -> DataFrame:
    """One row: six booleans and the score, from key files. licenses: path, license_expression, kind, score."""
    keys = flags.where("is_key_file").select(F.col(path).alias("_p"))
    own = licenses.join(keys, F.col(path) == F.col("_p"), "left_semi")
    stated = own.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 80).alias("good"), F.count_if(F.col("kind") == "text").alias("texts"),
        F.count_distinct("license_expression").alias("kinds"),
    )
    held = copyrights.join(keys, F.col(path) == F.col("_p"), "left_semi").agg(F.count(F.lit(1)).alias("c"))
    conflict = F.lit(False)
    joined = stated.crossJoin(held)  # one row each
    if categories is not None:
        outside = licenses.join(keys, F.col(path) == F.col("_p"), "left_anti").join(F.broadcast(categories), "license_expression").agg(F.count_if(F.col("category").startswith("Copyleft")).alias("copyleft"))
        inside = own.join(F.broadcast(categories), "license_expression").agg(F.count_if(F.col("category") == "Permissive").alias("permissive"))
        joined = joined.crossJoin(outside).crossJoin(inside)
        conflict = (F.col("copyleft") > 0) & (F.col("permissive") > 0)
    named = joined.select(
        (F.col("n") > 0).alias("declared_license"), ((F.col("n") > 0) & (F.col("good") == F.col("n"))).alias("identification_precision"),
        (F.col("texts") > 0).alias("has_license_text"), (F.col("c") > 0).alias("declared_copyrights"), conflict.alias("conflicting_license_categories"),
        (F.col("kinds") > 1).alias("ambiguous_compound_licensing"),
    )
    points: Column = F.lit(0)
    for name, n in CLARITY.items():
        points = points + F.when(F.col(name), n).otherwise(0)
    for name, n in CLARITY_PENALTY.items():
        points = points - F.when(F.col(name), n).otherwise(0)
    return named.select(F.greatest(points, F.lit(0)).alias("score"), "*")


def summary(flags: DataFrame, packages: DataFrame, licenses: DataFrame, holders: DataFrame, languages: DataFrame, path: str = "path") -> DataFrame:
    """One row: declared expression and holder (of a package first, then of key files), primary language, and the other
    values with their counts. Ties go to the smaller value."""
    keys = flags.where("is_key_file").select(F.col(path).alias("_p"))

    def best(rows: DataFrame, value: str, name: str) -> DataFrame:
        counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return counted.agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("v"))).alias("b")).select(F.col("b.v").alias(name))

    def others(rows: DataFrame, value: str, name: str) -> DataFrame:
        counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("count"))
        return counted.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("m"), "value"))).alias("t")).select(F.transform("t", lambda x: F.struct(x["value"].alias("value"), (-x["m"]).alias("count"))).alias(name))

    in_keys = lambda rows: rows.join(keys, F.col(path) == F.col("_p"), "left_semi")
    parts = [
        best(packages, "declared_license_expression", "_package_license"), best(in_keys(licenses), "license_expression", "_key_license"),
        best(packages, "holder", "_package_holder"), best(in_keys(holders), "holder", "_key_holder"), best(languages, "programming_language", "primary_language"),
        others(licenses, "license_expression", "_licenses"), others(holders, "holder", "_holders"), others(languages, "programming_language", "_languages"),
    ]
    one = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    drop = lambda c, v: F.filter(c, lambda x: ~F.coalesce(x["value"] == v, F.lit(False)))
    stated = one.withColumn("declared_license_expression", F.coalesce("_package_license", "_key_license")).withColumn("declared_holder", F.coalesce("_package_holder", "_key_holder"))
    return stated.select(
        "declared_license_expression", "declared_holder", "primary_language", drop(F.col("_licenses"), F.col("declared_license_expression")).alias("other_license_expressions"),
        drop(F.col("_holders"), F.col("declared_holder")).alias("other_holders"), drop(F.col("_languages"), F.col("primary_language")).alias("other_languages"),
    )


def facet_language_cube(with_facets: DataFrame, languages: DataFrame, path: str = "path") -> DataFrame:
    """An addition: counts by facet, by language, by both and over all."""
    opened = with_facets.select(path, F.explode("facets").alias("facet")).join(languages.select(F.col(path).alias("_p"), "programming_language"), F.col(path) == F.col("_p"))
    return opened.cube("facet", "programming_language").agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("level"))


def rank_values(counted: DataFrame, by: list[str], most: int) -> DataFrame:
    """The ``most`` frequent values of each group; ties by value."""
    order = Window.partitionBy(*by).orderBy(F.desc("count"), F.asc_nulls_last("value"))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
