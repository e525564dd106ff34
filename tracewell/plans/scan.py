"""A whole scan: which detectors run, in which order results are shaped, and the report.

The plan is built from the options, so a detector that isn't asked for is no part of it. Order: select paths, detect,
drop clues and ignored resources, keep findings, mark sources, assemble packages, strip roots, summarise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_generated, is_source
from ..operators import assembly as asm
from ..operators import copyright as cr
from ..operators import finder as fd
from ..operators import license as lic
from ..operators import rules as rl
from ..operators import summary as sm
from ..operators import tree as tr
from ..parsers import package_data
from ..sinks import Report, nest_files
from ..sources.files import file_info, texts_of
from ..sources.work import Keeper


@dataclass(frozen=True)
class ScanOptions:
    info: bool = False
    packages: bool = False
    licenses: bool = False
    copyrights: bool = True
    generated: bool = False
    emails: bool = False
    urls: bool = False
    max_emails: int = 50
    max_urls: int = 50
    unknown_licenses: bool = False
    license_text: bool = False
    license_references: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_depth: int = 0
    filter_clues: bool = False
    only_findings: bool = False
    ignore_author: tuple[str, ...] = ()
    ignore_copyright_holder: tuple[str, ...] = ()
    mark_source: bool = False
    strip_root: bool = False
    full_root: str | None = None
    assemble: bool = True
    classify: bool = False
    summary: bool = False
    license_clarity_score: bool = False
    tallies: bool = False
    tallies_key_files: bool = False
    tallies_with_details: bool = False
    tallies_by_facet: bool = False
    facets: tuple[tuple[str, str], ...] = ()


@dataclass
class Scan:
    """Frames of a scan: files (info and flags), fact tables by name, packages, dependencies, and summaries."""

    spark: SparkSession
    files: DataFrame
    facts: dict[str, DataFrame] = field(default_factory=dict)
    packages: DataFrame | None = None
    dependencies: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def report(self, header: dict | None = None) -> Report:
        named = {k: self.extra.get(k) for k in ("summary", "tallies", "tallies_of_key_files", "tallies_by_facet", "license_detections", "license_references", "license_rule_references")}
        return Report(self.spark, nest_files(self.files, self.facts), header or {}, self.packages, self.dependencies, **named)


def findings(texts: DataFrame, options: ScanOptions, rules: DataFrame | None = None, keep=lambda name, df: df) -> dict[str, DataFrame]:
    """Fact tables of texts (path, text): the detectors that are asked for. Each reads the texts in one pass.

    keep: what a table that is read more than once goes through, such as a Keeper."""
    out: dict[str, DataFrame] = {}
    if options.copyrights:
        found = keep("statements", cr.detect_copyrights(texts))
        credits = cr.credits_authors(texts.where(cr.is_credits_file(F.col("path"))))
        for name, kind in (("copyrights", "copyright"), ("holders", "holder"), ("authors", "author")):
            out[name] = found.where(F.col("kind") == kind).select("path", F.col("value").alias(kind), "start_line", "end_line")
        out["authors"] = out["authors"].unionByName(credits)
    if options.emails:
        out["emails"] = fd.find_emails(texts, max_emails=options.max_emails)
    if options.urls:
        out["urls"] = fd.find_urls(texts, max_urls=options.max_urls)
    if options.licenses:
        rules = rl.default_rules(texts.sparkSession) if rules is None else rules
        matches = keep("license_matches", lic.scan_licenses(texts, rules))
        detecting, clues = lic.split_clues(matches)
        out["license_detections"], out["license_clues"] = lic.detections(detecting), clues
        if options.filter_clues:
            for name, value, ignorable in (("copyrights", "copyright", "ignorable_copyrights"), ("holders", "holder", "ignorable_holders"), ("authors", "author", "ignorable_authors"), ("emails", "email", "ignorable_emails"), ("urls", "url", "ignorable_urls")):
                if name in out:
                    out[name] = lic.without_ignorables(tr.unique_findings(out[name], "path", value), matches, rules, value, ignorable)
        if options.license_text:
            out["license_share"] = lic.license_share(texts, matches)
    return out


def shaped(tree: DataFrame, facts: dict[str, DataFrame], options: ScanOptions) -> DataFrame:
    """The tree (path, is_dir, is_source) without what is ignored, and with only findings if asked."""
    out = tree
    for name, value, patterns in (("authors", "author", options.ignore_author), ("holders", "holder", options.ignore_copyright_holder)):
        if patterns and name in facts:
            out = tr.drop_matching(out, facts[name], value, list(patterns))
    if options.only_findings:
        out = tr.only_findings(out, [f for f in facts.values()])
    return out


def assembled(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages and dependencies of manifest rows (see parsers): siblings, rows of their own, nested layouts, and what is
    left over."""
    siblings, dependencies = asm.sibling_packages(manifests)
    nested = asm.nested_packages(manifests)
    each = asm.each_packages(manifests)
    columns = [c for c in siblings.columns if c not in ("parent_path", "assembler", "dependencies")]
    pick = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(dict(siblings.dtypes)[c]).alias(c) for c in columns])
    packages = asm.replace_by_nested(pick(siblings).unionByName(pick(each)), pick(nested))
    owners = packages.select(F.explode("datafile_paths").alias("path"))
    rest = asm.unassembled_dependencies(manifests, owners)
    return packages, dependencies.unionByName(rest, allowMissingColumns=True)


def scan(files: DataFrame, options: ScanOptions | None = None, rules: DataFrame | None = None, licenses: DataFrame | None = None, work: str | None = None) -> Scan:
    """files: path, content. Tables that more than one step reads are written below ``work`` (by default the cluster's
    shared folder)."""
    options = options or ScanOptions()
    spark = files.sparkSession
    keep = Keeper(spark, work)
    tree = tr.with_directories(files.select("path"))
    tree = keep("tree", tr.include_exclude(tr.limit_depth(tree, options.max_depth), list(options.include), list(options.exclude)))
    kept = files.join(tree.where(~F.col("is_dir")).select("path"), "path", "left_semi")
    texts = keep("texts", texts_of(kept))
    facts = {name: keep(name, rows) for name, rows in findings(texts, options, rules, keep).items()}
    flagged = keep("shaped", shaped(tree, {k: v for k, v in facts.items() if "start_line" in v.columns}, options))
    info = file_info(kept) if options.info else kept.select("path", F.lit("file").alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"))
    if options.generated:
        info = info.join(texts.select("path", is_generated(F.col("text")).alias("is_generated")), "path", "left")
    directories = flagged.where("is_dir").select("path", F.lit("directory").alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"))
    out = info.join(flagged.where(~F.col("is_dir")).select("path"), "path", "left_semi").unionByName(directories, allowMissingColumns=True)
    if options.mark_source:
        marked = tr.mark_source(flagged.select("path", "is_dir", F.when(~F.col("is_dir"), is_source(F.col("path"))).alias("is_source")))
        out = out.drop("is_source").join(marked, "path", "left")
    if "license_share" in facts:
        out = out.join(facts.pop("license_share"), "path", "left")
    packages = dependencies = None
    if options.packages:
        facts["package_data"] = keep("package_data", package_data(kept))
        if options.assemble:
            packages, dependencies = assembled(facts["package_data"])
            packages, dependencies = keep("packages", packages), keep("dependencies", dependencies)
    extra: dict[str, DataFrame] = {}
    own = flagged.where(~F.col("is_dir")).select("path")
    if options.classify or options.tallies_key_files or options.summary or options.license_clarity_score:
        extra["flags"] = keep("flags", sm.classify(own, packages=packages))
        if options.classify:
            out = out.join(extra["flags"], "path", "left")
    if options.facets or options.tallies_by_facet:
        extra["facets"] = keep("facets", sm.facets(own, list(options.facets)))
        out = out.join(extra["facets"], "path", "left")
    out = keep("files", out)
    _summarise(out, facts, packages, extra, options, licenses)
    if options.strip_root or options.full_root is not None:
        change = (lambda c: tr.full_root(c, options.full_root)) if options.full_root is not None else (lambda c: tr.strip_root(c, ""))
        out = out.withColumn("path", change(F.col("path")))
        facts = {k: v.withColumn("path", change(F.col("path"))) for k, v in facts.items()}
    return Scan(spark, out, facts, packages, dependencies, extra)


def _summarise(files: DataFrame, facts: dict[str, DataFrame], packages: DataFrame | None, extra: dict[str, DataFrame], options: ScanOptions, licenses: DataFrame | None) -> None:
    own = files.where("type = 'file'")
    counted = {
        name: (facts[table], value) for name, table, value in (("detected_license_expression", "license_detections", "license_expression"), ("copyrights", "copyrights", "copyright"), ("holders", "holders", "holder"), ("authors", "authors", "author"))
        if table in facts
    }
    if "programming_language" in files.columns:
        counted["programming_language"] = (own.select("path", "programming_language"), "programming_language")
    if options.tallies and counted:
        extra["tallies"] = sm.tallies(own, counted)
    if options.tallies_key_files and counted:
        keys = extra["flags"].where("is_key_file").select("path")
        extra["tallies_of_key_files"] = sm.tallies(keys, {k: (rows.join(keys, "path", "left_semi"), v) for k, (rows, v) in counted.items()})
    if options.tallies_by_facet and counted:
        extra["tallies_by_facet"] = sm.tallies_by_facet(own, extra["facets"], counted)
    if options.tallies_with_details and counted:
        extra["detailed_tallies"] = sm.detailed_tallies(counted)
    if "license_detections" in facts:
        found = facts["license_detections"]
        identified = found.withColumn("identifier", F.concat(F.regexp_replace("license_expression", "[^A-Za-z0-9]+", "_"), F.lit("-"), F.substring(F.sha1(F.to_json("matches.rid").cast("binary")), 1, 32)))
        extra["license_detections"] = lic.unique_detections(identified)
        if options.license_references:
            matches = found.select("path", F.inline("matches"))
            extra["license_references"] = lic.license_references(matches, rl.default_licenses(files.sparkSession) if licenses is None else licenses)
            extra["license_rule_references"] = lic.rule_references(matches, rl.default_rules(files.sparkSession))
    if options.license_clarity_score and "license_detections" in facts and "copyrights" in facts:
        extra["clarity"] = sm.clarity(extra["flags"], facts["license_detections"].select("path", F.inline("matches")), facts["copyrights"])
    if options.summary and "license_detections" in facts and "holders" in facts:
        none = own.sparkSession.createDataFrame([], "declared_license_expression string, holder string")
        languages = own.select("path", "programming_language") if "programming_language" in files.columns else own.select("path", F.lit(None).cast("string").alias("programming_language"))
        extra["summary"] = sm.summary(extra["flags"], packages if packages is not None else none, facts["license_detections"].select("path", "license_expression"), facts["holders"], languages)
