"""Queries for single operators: texts, sources, rules, assembly, scores and documents, each with its SQL.

Inputs that the tables don't hold (manifests, earlier scans, rule files) are made from their keys.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as tx
from ..operators import assembly as asm
from ..operators import finder as fd
from ..operators import license as lic
from ..operators import rules as rl
from ..operators import summary as sm
from ..operators import tree as tr
from ..sinks import html_report, json_document, yaml_document
from ..sinks.lines import escape_xml
from ..sources import cache, files, scans
from ..sources.work import Keeper, work_folder
from .registry import query, table
from .text_queries import _list
from .tree_queries import FILES, files_of, report_of

_long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
_no_strings = "array<string>"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid4().hex}"


def _pick(key: str, *values: str | None) -> Column:
    """The value at key modulo the number of values."""
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


# Sources -----------------------------------------------------------------------------------------------------------


@query(f"SELECT path FROM ({FILES}) WHERE source = 'src1' AND lang IN ('en', 'de')")
def tree_several_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two relative inputs: their common root, and each as an include pattern."""
    root, patterns = tr.common_root(["src1/en", "./src1/de/"])
    below = files_of(spark, sf_dir).where(F.col("path").startswith(root + "/")).select("path")
    kept = tr.include_exclude(tr.with_directories(below), [f"{p}/*" for p in patterns])
    return kept.where(~F.col("is_dir")).select("path")


def _earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan for each document, as lines of JSON that are written and loaded."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    entry = F.struct(F.concat("source", F.lit("/doc_"), "doc_id").alias("path"), F.lit("file").alias("type"), F.col("n_chars").alias("size"), F.lit("x").alias("not_known"))
    folder = F.struct(F.col("source").alias("path"), F.lit("directory").alias("type"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("not_known"))
    head = F.array(F.struct(F.struct((F.col("doc_id") % 3).alias("excluded_count")).alias("extra_data")))
    path = _folder(spark, "scans")
    d.select(F.to_json(F.struct(head.alias("headers"), F.array(folder, entry).alias("files"))).alias("value")).write.text(path)
    return scans.load_scans(spark, path, lines=True)


@query("SELECT concat(source, '/doc_', doc_id) AS path, 'file' AS type, n_chars AS size FROM documents UNION ALL SELECT source, 'directory', NULL FROM documents")
def earlier_scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of scans that were written before."""
    return scans.section(_earlier(spark, sf_dir), "files").select("path", "type", *_long("size"))


@query("SELECT count(*) AS files_count, count(*) AS directories_count, sum(n_chars)::BIGINT AS size_count, sum(doc_id % 3)::BIGINT AS excluded_count FROM documents")
def earlier_scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of scans that are merged."""
    return scans.merged_counts(_earlier(spark, sf_dir)).select(*_long("files_count", "directories_count", "size_count", "excluded_count"))


@query("SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) AS known FROM documents")
def result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents have a result in a store that was filled from every second one."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    folder, mark = cache.cache_folder(work_folder(spark), _folder(spark, "cache")), cache.fingerprint({"emails": True})
    cache.store(d.where("path % 2 = 0").select("sha256", F.length("sha256").alias("value")), folder, mark)
    left, known = cache.probe(d, cache.cached(spark, folder, mark))
    return left.select(F.col("path").alias("doc_id"), F.lit(False).alias("known")).unionByName(known.select(F.col("path").alias("doc_id"), F.lit(True).alias("known")))


@query("SELECT doc_id, md5(CASE doc_id % 4 WHEN 1 THEN concat('plain', text) WHEN 3 THEN concat('word', chr(10), 'longer') ELSE text END) AS md5 FROM documents")
def extracted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of files as UTF-8, with a byte-order mark, in a source map, and as readable runs of a binary."""
    d, k = table(spark, sf_dir, "documents", "doc_id", "text"), F.col("doc_id") % 4
    binary = F.unhex(F.lit("0001" + b"word".hex() + "00" + b"ab".hex() + "00" + b"longer".hex()))
    content = (
        F.when(k == 0, F.concat(F.lit("﻿"), "text").cast("binary")).when(k == 1, F.concat(F.lit("plain"), "text").cast("binary"))
        .when(k == 2, F.to_json(F.struct(F.array("text").alias("sourcesContent"))).cast("binary")).otherwise(binary)
    )
    path = F.concat(F.col("doc_id").cast("string"), F.when(k == 2, ".js.map").otherwise(".bin"))
    found = files.texts_of(d.select(path.alias("path"), content.alias("content")))
    return found.select(F.substring_index("path", ".", 1).cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("md5"))


_TEXTS = ("a\\nb\\tc\\r.", "-----BEGIN CERTIFICATE-----\nMII", " -----BEGIN RSA KEY-----\nMII", "x -----BEGIN CERTIFICATE-----", "-----BEGIN SONG-----")


@query(f"""
SELECT p_partkey, [{', '.join("'" + t.replace(chr(10), "' || chr(10) || '") + "'" for t in (t.replace('\\n', ' ').replace('\\t', ' ').replace('\\r', ' ') for t in _TEXTS))}][1 + p_partkey % 5] AS text, p_partkey % 5 IN (1, 2) AS is_pem FROM part
""")
def pem_and_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written-out white space, and texts that are keys or certificates."""
    text = _pick("p_partkey", *_TEXTS)
    return table(spark, sf_dir, "part", "p_partkey").select("p_partkey", tx.unescape_space(text).alias("text"), tx.is_pem(text).alias("is_pem"))


@query("SELECT p_partkey, p_partkey % 4 = 0 AS zip, p_partkey % 4 = 1 AS squashfs, p_partkey % 4 = 2 AS nsis FROM part")
def magic_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First bytes."""
    heads = _pick("p_partkey", "PK\x03\x04", "hsqs", "MZ..Nullsoft.NSIS.exehead", "PK..hsqs")
    content = F.concat(heads, F.col("p_name")).cast("binary")
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", tx.is_zip(content).alias("zip"), tx.is_squashfs(content).alias("squashfs"), tx.is_nsis(content).alias("nsis"))


@query("SELECT doc_id, 1 + length(h) - length(replace(h, chr(10), '')) AS line FROM (SELECT doc_id, left(text, length(text) // 2) AS h FROM documents)")
def offset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line in which a text's middle lies."""
    middle = F.floor(F.length("text") / 2).cast("int")
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", tx.line_at(F.col("text"), middle).cast("long").alias("line"))


# URLs --------------------------------------------------------------------------------------------------------------


@query(r"""
WITH lines AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS s FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages)),
found AS (SELECT page_id, line, unnest(u) AS raw, generate_subscripts(u, 1) - 1 AS pos FROM (SELECT page_id, line, regexp_extract_all(s, '(?i)(?:https?|ftps?|sftp|rsync|ssh|svn|git|hg|https?\+(?:git|svn|hg))://[^\s<>\[\]"]+|(?:www|ftp)\.[^\s<>\[\]"]+|git@[^\s<>\[\]"]+:[^\s<>\[\]"]+\.git') AS u FROM lines))
SELECT page_id, line, pos, regexp_replace(regexp_replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\\<>()\[\]"''].*$', ''), '[,.:;!?]+$', '') AS value FROM found
""")
def url_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL in the pages' text, cleaned."""
    return fd.url_candidates(table(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html").select("page_id", *_long("line", "pos"), "value")


@query(r"""
WITH lines AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS s FROM (SELECT page_id, string_split(replace(html, '.example.', '.site.'), chr(10)) AS l FROM pages)),
found AS (SELECT page_id, line, unnest(u) AS raw, generate_subscripts(u, 1) AS pos FROM (SELECT page_id, line, regexp_extract_all(s, '(?i)www\.[^\s<>\[\]"]+') AS u FROM lines)),
named AS (SELECT page_id, line, pos, concat('http://', regexp_replace(raw, '[,.:;!?]+$', ''), '/') AS url FROM found),
once AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY line, pos) = 1)
SELECT page_id, url, line AS start_line, line AS end_line FROM once QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY line, pos) <= 50
""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs of the pages' text, once each, 50 a page (F4 to F10), with hosts that the junk filter leaves alone."""
    moved = table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.replace("html", F.lit(".example."), F.lit(".site.")).alias("html"))
    return fd.find_urls(moved, "page_id", "html").select("page_id", "url", *_long("start_line", "end_line"))


_URLS = (*fd.JUNK_URLS, *(u + "x" for u in fd.JUNK_URL_STARTS), *(u + "/q" for u in fd.JUNK_URLS), "http://corp.io/a.PNG", "http://corp.io/png", "HTTP://WWW.W3.ORG/P3P//")


@query(f"""
WITH u AS (SELECT p_partkey, [{_list(_URLS)}][1 + p_partkey % {len(_URLS)}] AS url FROM part), b AS (SELECT p_partkey, url, rtrim(lower(url), '/') AS low FROM u)
SELECT p_partkey, url, low IN ({_list(fd.JUNK_URLS)}) OR len(list_filter([{_list(fd.JUNK_URL_STARTS)}], lambda s: starts_with(low, s))) > 0 OR regexp_matches(low, '[.](?:png|jpg|gif|jpeg)$') AS junk FROM b
""")
def url_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that the fixed lists drop."""
    url = _pick("p_partkey", *_URLS)
    return table(spark, sf_dir, "part", "p_partkey").select("p_partkey", url.alias("url"), fd.is_junk_url(url).alias("junk"))


_HOSTS = ("8.8.8.8", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.7.7", "127.0.0.1", "224.0.0.9", "203.0.113.5", "1.2.3.4", "corp.io", "nodot", "a.b.c.corp.io", "img.gif", "sub.example.com", "")


@query(f"SELECT s_suppkey, [{_list(_HOSTS)}][1 + s_suppkey % {len(_HOSTS)}] AS host, s_suppkey % {len(_HOSTS)} IN (0, 3, 9) AS good FROM supplier")
def host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public hosts."""
    host = _pick("s_suppkey", *_HOSTS)
    return table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", host.alias("host"), fd.is_good_host(host).alias("good"))


@query("SELECT s_suppkey, concat('git@host', s_suppkey, ':team/repo.git') AS url, 2::BIGINT AS start_line FROM supplier")
def git_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of repositories pass as they are (F8)."""
    text = F.concat(F.lit("clone\n from git@host"), "s_suppkey", F.lit(":team/repo.git now"))
    return fd.find_urls(table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", text.alias("text")), "s_suppkey").select("s_suppkey", "url", *_long("start_line"))


# Spans, rules, detections ------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT l_orderkey, l_suppkey % 40 AS a, l_suppkey % 40 + l_quantity::BIGINT % 9 AS b FROM lineitem),
p AS (SELECT DISTINCT l_orderkey, unnest(range(a, b)) AS i FROM s), n AS (SELECT l_orderkey, count(*) AS length, count(*) FILTER (i >= 10 AND i < 20) AS shared FROM p GROUP BY l_orderkey)
SELECT o.l_orderkey, coalesce(length, 0) AS length, coalesce(shared, 0) AS shared, coalesce(shared, 0) > 0 AS meets, coalesce(shared, 0) = 10 AS covers FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN n USING (l_orderkey)
""")
def span_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, length, overlap and containment of spans by their positions."""
    a = F.col("l_suppkey") % 40
    b = a + F.col("l_quantity").cast("long") % 9
    span = F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    held = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_quantity").groupBy("l_orderkey").agg(F.collect_list(span).alias("s"))
    ten = F.array(F.struct(F.lit(10).alias("start"), F.lit(20).alias("end")))
    own = F.filter("s", lambda r: r["start"] < r["end"])
    return held.select("l_orderkey", spans.length(F.col("s")).cast("long").alias("length"), spans.overlap(own, ten).cast("long").alias("shared"), spans.intersects(own, ten).alias("meets"), spans.covers(own, ten).alias("covers"))


@query("""
SELECT p_partkey, concat('mit_AND_x', p_size, '-', h[1:8], '-', h[9:12], '-', h[13:16], '-', h[17:20], '-', h[21:32]) AS identifier
FROM (SELECT p_partkey, p_size, sha1(concat('((''r', p_partkey, '.RULE'', ', p_size, '.0, (''mit'', ''license'')), (''two'', 100.0, ()))')) AS h FROM part)
""")
def detection_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable names of detections from their rules, scores and tokens."""
    one = lambda rule, score, tokens: F.struct(rule.alias("rule"), score.cast("double").alias("score"), tokens.alias("tokens"))
    content = F.array(
        one(F.concat(F.lit("r"), F.col("p_partkey"), F.lit(".RULE")), F.col("p_size"), F.array(F.lit("mit"), F.lit("license"))), one(F.lit("two"), F.lit(100), F.array().cast(_no_strings))
    )
    expression = F.concat(F.lit("mit AND x"), F.col("p_size"))
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", lic.identifier_column(expression, content).alias("identifier"))


def _rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _pick("p_partkey", "is_license_notice: yes", "is_license_text: yes", "is_license_clue: yes", "is_false_positive: yes", "other: 1")
    text = F.concat(F.lit("---\nlicense_expression: mit\n"), flags, F.lit("\nrelevance: "), F.col("p_size") % 100, F.lit("\nignorable_urls:\n  - http://corp.io/"), F.col("p_partkey"), F.lit("\n---\n"), F.col("p_name"), F.lit("\n"))
    return table(spark, sf_dir, "part", "p_partkey", "p_size", "p_name").select(F.concat(F.lit("rules/r"), F.col("p_partkey"), F.lit(".RULE")).alias("path"), text.alias("text"))


_RULE_FILES = """
SELECT concat('r', p_partkey, '.RULE') AS identifier, 'mit' AS license_expression, ['notice', 'text', 'clue', NULL][1 + p_partkey % 5] AS kind, (p_size % 100)::BIGINT AS relevance, p_name AS text, p_partkey % 5 = 3 AS is_false_positive,
  concat('http://corp.io/', p_partkey) AS ignorable, concat('https://corp.io/rules/r', p_partkey, '.RULE') AS url FROM part WHERE p_partkey % 5 <> 4
"""


@query(_RULE_FILES)
def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule files with their kinds and addresses, kept as an index and read back."""
    folder = _folder(spark, "index")
    rl.write_index(rl.load_rules(_rule_files(spark, sf_dir)), rl.default_licenses(spark), folder)
    rules, _ = rl.read_index(spark, folder)
    return rules.select("identifier", "license_expression", "kind", *_long("relevance"), "text", "is_false_positive", F.get("ignorable_urls", F.lit(0)).alias("ignorable"), rl.rule_url(F.col("identifier"), F.col("is_from_license"), "https://corp.io/").alias("url"))


@query("""
SELECT concat('l', p_partkey) AS key, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE concat('short ', p_size) END AS name, concat('short ', p_size) AS short_name, CASE WHEN p_partkey % 3 = 0 THEN concat('SPDX-', p_partkey) END AS spdx,
  2::BIGINT AS urls, p_partkey % 4 = 0 AS deprecated, CASE WHEN p_partkey % 4 <> 0 THEN concat('l', p_partkey, '.LICENSE') END AS rule FROM part
""")
def license_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License files and the rules that their texts make."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand")
    line = lambda hit, *parts: F.when(hit, F.concat(*parts, F.lit("\n"))).otherwise("")
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("---\nkey: any\nshort_name: short "), F.col("p_size"), F.lit("\n"), line(k % 2 == 0, F.lit("name: '"), F.col("p_brand"), F.lit("'")), line(k % 3 == 0, F.lit("spdx_license_key: SPDX-"), k),
        line(k % 4 == 0, F.lit("is_deprecated: yes")), F.lit("text_urls:\n  - ' http://a.io/x '\n  - http://a.io/x\nhomepage_url: http://b.io\n---\n"), F.when(k % 4 == 0, "").otherwise("license text\n"),
    )
    made = Keeper(spark)("licenses", rl.load_licenses(p.select(F.concat(F.lit("licenses/l"), k, F.lit(".LICENSE")).alias("path"), text.alias("text"))))
    rules = rl.license_rules(made).select(F.col("license_expression").alias("key"), F.col("identifier").alias("rule"))
    return made.join(rules, "key", "left").select("key", "name", "short_name", F.col("spdx_license_key").alias("spdx"), F.size("reference_urls").cast("long").alias("urls"), F.col("is_deprecated").alias("deprecated"), "rule")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'http://other.io' WHEN 1 THEN 'http://known.io' END AS url, 5::BIGINT AS start_line, 5::BIGINT AS end_line FROM part WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_size % 2 = 0)")
def ignorable_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a matched rule explains are dropped where the lines overlap."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size").where("p_partkey % 3 <> 2")
    findings = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "http://other.io").otherwise("http://known.io").alias("url"), F.lit(5).alias("start_line"), F.lit(5).alias("end_line"))
    first = F.when(F.col("p_size") % 2 == 0, 6).otherwise(4)
    matches = p.select("p_partkey", F.lit(1).alias("rid"), first.alias("start_line"), (first + 2).alias("end_line"))
    rules = spark.createDataFrame([(1, ["http://known.io"])], "rid int, ignorable_urls array<string>")
    return lic.without_ignorables(findings, matches, rules, "url", "ignorable_urls", "p_partkey").select("p_partkey", "url", *_long("start_line", "end_line"))


# Assembly ----------------------------------------------------------------------------------------------------------

_NEED = "array<struct<purl:string,extracted_requirement:string,scope:string>>"


def _manifest(df: DataFrame, path: Column, source: str, kind: str, name: Column, need: Column | None = None, version: str | None = "1") -> DataFrame:
    purl = F.concat(F.lit(f"pkg:{kind}/"), name, F.lit(f"@{version}"))
    needs = F.array().cast(_NEED) if need is None else F.array(F.struct(need.alias("purl"), F.lit("*").alias("extracted_requirement"), F.lit("s").alias("scope"))).cast(_NEED)
    return df.select(path.alias("path"), F.lit(source).alias("datasource_id"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("namespace"), name.alias("name"), F.lit(version).alias("version"), purl.alias("purl"), needs.alias("dependencies"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _none() -> Column:
    return F.lit(None).cast("string")


@query("SELECT concat('n', n_nationkey, '-', k) AS name, 'lib/apk/db/installed' AS path, concat('pkg:apk/n', n_nationkey, '-', k, '@1') AS bare FROM nation, range(3) AS r(k) WHERE k > 0")
def installed_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of an installed database is a package."""
    n = table(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    name = F.when(F.col("k") > 0, _text("n", F.col("n_nationkey"), "-", F.col("k")))
    made = asm.each_packages(_manifest(n, F.lit("lib/apk/db/installed"), "alpine_installed_db", "apk", name))
    return made.select("name", F.col("datafile_paths")[0].alias("path"), F.substring_index("package_uid", "?", 1).alias("bare"))


@query("SELECT concat('j', s_suppkey) AS root, concat('s', s_suppkey) AS name, 2::BIGINT AS files FROM supplier WHERE s_suppkey % 3 = 0")
def nested_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A POM and a manifest below one root are a package; a lone file and a root with two POMs aren't."""
    s, k = table(spark, sf_dir, "supplier", "s_suppkey"), F.col("s_suppkey")
    pom = lambda rows, d: _manifest(rows, _text("j", k, f"/META-INF/maven/g/{d}/pom.xml"), "maven_pom", "maven", _text("s", k))
    jar = _manifest(s.where("s_suppkey % 3 <> 1"), _text("j", k, "/META-INF/MANIFEST.MF"), "java_jar_manifest", "maven", _none())
    made = asm.nested_packages(pom(s, "a").unionByName(pom(s.where("s_suppkey % 3 = 2"), "b")).unionByName(jar))
    return made.select("root", "name", F.size("datafile_paths").cast("long").alias("files"))


@query("""
WITH d AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'gem_archive_extracted' ELSE 'gemspec' END AS source, l_orderkey, l_partkey % 3 AS k FROM lineitem)
SELECT source, l_orderkey, concat('pkg:gem/g', k) AS purl, CASE WHEN source = 'gemspec' THEN count(*) ELSE 1 END AS n FROM d GROUP BY source, l_orderkey, k
""")
def gem_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of extracted gems once each, others as often as they are listed."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").select(
        F.when(F.col("l_linenumber") % 2 == 0, "gem_archive_extracted").otherwise("gemspec").alias("datasource_id"), F.col("l_orderkey").alias("for_package_uid"), _text("pkg:gem/g", F.col("l_partkey") % 3).alias("purl"),
        F.lit("*").alias("extracted_requirement"), F.lit("runtime").alias("scope"),
    )
    return asm.distinct_gem_dependencies(rows).groupBy(F.col("datasource_id").alias("source"), F.col("for_package_uid").alias("l_orderkey"), "purl").agg(F.count(F.lit(1)).alias("n"))


def _hackage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, k = table(spark, sf_dir, "supplier", "s_suppkey"), F.col("s_suppkey")
    cabal = lambda rows, n: _manifest(rows, _text("h", k, f"/{n}.cabal"), "hackage_cabal", "hackage", _text(f"{n}", k))
    project = _manifest(s, _text("h", k, "/cabal.project"), "hackage_cabal_project", "hackage", _none(), _text("pkg:hackage/d", k), None)
    return asm.hackage_packages(cabal(s.where("s_suppkey % 3 > 0"), "a").unionByName(cabal(s.where("s_suppkey % 3 = 2"), "b")).unionByName(project))


@query("""
SELECT concat('a', s_suppkey) AS name, CASE WHEN s_suppkey % 3 = 1 THEN 2 ELSE 1 END::BIGINT AS files FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT concat('b', s_suppkey), 1 FROM supplier WHERE s_suppkey % 3 = 2
""")
def hackage_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One package of a directory with one cabal file, and one for each file where there are several (A10)."""
    return _hackage(spark, sf_dir)[0].select("name", F.size("datafile_paths").cast("long").alias("files"))


@query("SELECT concat('pkg:hackage/d', s_suppkey) AS purl, s_suppkey % 3 = 1 AS owned FROM supplier")
def hackage_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's dependencies belong to the only package beside it (A10)."""
    return _hackage(spark, sf_dir)[1].select("purl", F.col("for_package_uid").isNotNull().alias("owned"))


def _conda(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, k = table(spark, sf_dir, "supplier", "s_suppkey"), F.col("s_suppkey")
    one = lambda rows, uid, source, file, purl, held: rows.select(uid.alias("package_uid"), purl.alias("purl"), F.array(F.lit(source)).alias("datasource_ids"), F.array(file).alias("datafile_paths"), held.alias("extracted_package_dir"))
    installed = one(s, _text("i", k), "conda_meta_json", _text("conda-meta/", k, ".json"), _text("pkg:conda/p", k), _text("/pkgs/p", k, "/"))
    other = F.when(k % 2 == 0, _text("pkg:conda/p", k)).otherwise(_text("pkg:conda/q", k))
    recipes = one(s, _text("r", k), "conda_meta_yaml", _text("pkgs/p", k, "/info/recipe/meta.yaml"), other, _none())
    held = s.select(_text("pkgs/p", k, "/lib.so").alias("path"), _text("r", k).alias("for_package"))
    needs = s.select(_text("pkg:conda/d", k).alias("purl"), _text("r", k).alias("for_package_uid"))
    return asm.conda_merge(installed.unionByName(recipes), held, needs)


@query("""
SELECT concat('i', s_suppkey) AS package_uid, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS files FROM supplier UNION ALL SELECT concat('r', s_suppkey), 1 FROM supplier WHERE s_suppkey % 2 = 1
""")
def conda_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes fold into the installed package that holds them."""
    return _conda(spark, sf_dir)[0].select("package_uid", F.size("datafile_paths").cast("long").alias("files"))


@query("SELECT concat('pkgs/p', s_suppkey, '/lib.so') AS path, concat(CASE WHEN s_suppkey % 2 = 0 THEN 'i' ELSE 'r' END, s_suppkey) AS owner, concat('pkg:conda/d', s_suppkey) AS purl FROM supplier")
def conda_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and dependencies of folded recipes."""
    _, held, needs = _conda(spark, sf_dir)
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1)
    return held.select("path", F.col("for_package").alias("owner"), number(F.col("path")).alias("n")).join(needs.select("purl", F.col("for_package_uid").alias("_o"), number(F.col("purl")).alias("n")), "n").where("owner = _o").select("path", "owner", "purl")


_OWNED = """
SELECT concat('c', o_custkey, '/o', o_orderkey, '/', d, '/f') AS path, CASE WHEN o_orderkey % 2 = 0 AND d <> '{skipped}' THEN concat('o', o_orderkey) ELSE concat('c', o_custkey) END AS package_uid FROM orders, (VALUES ('{skipped}'), ('src')) v(d)
WHERE o_custkey IN (SELECT c_custkey FROM customer) OR (o_orderkey % 2 = 0 AND d <> '{skipped}')
"""


def _owned(spark: SparkSession, sf_dir: str, kind: str, manifest: str, skipped: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer", "c_custkey"), table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    folder = _text("c", F.col("o_custkey"), "/o", F.col("o_orderkey"))
    made = lambda df, at, uid: df.select(F.lit(kind).alias("type"), F.array(_text(at, f"/{manifest}")).alias("datafile_paths"), uid.alias("package_uid"))
    packages = made(customers, _text("c", F.col("c_custkey")), _text("c", F.col("c_custkey"))).unionByName(made(orders.where("o_orderkey % 2 = 0"), folder, _text("o", F.col("o_orderkey"))))
    names = orders.select(folder.alias("at"), F.explode(F.array(F.lit(skipped), F.lit("src"))).alias("d")).select(_text(F.col("at"), "/", F.col("d"), "/f").alias("path"))
    return asm.owned_files(names, packages, kind)


@query(_OWNED.format(skipped="vendor"))
def composer_owned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest root owns a file, but not what is in its vendor folder."""
    return _owned(spark, sf_dir, "composer", "composer.json", "vendor")


@query(_OWNED.format(skipped=asm.CACHE_DIRECTORY))
def gem_owned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for gems and their cache folder."""
    return _owned(spark, sf_dir, "gem", "x.gemspec", asm.CACHE_DIRECTORY)


@query("SELECT concat('p', s_suppkey, '/sub/requirements/dev.txt') AS path, concat('u', s_suppkey) AS package_uid FROM supplier WHERE s_suppkey % 3 = 0")
def requirement_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one nearest project above a folder of requirements."""
    s, k = table(spark, sf_dir, "supplier", "s_suppkey"), F.col("s_suppkey")
    project = lambda rows, file, uid: rows.select(F.lit("pypi").alias("type"), F.array(_text("p", k, f"/{file}")).alias("datafile_paths"), _text(uid, k).alias("package_uid"))
    packages = project(s.where("s_suppkey % 3 < 2"), "setup.py", "u").unionByName(project(s.where("s_suppkey % 3 = 1"), "pyproject.toml", "v"))
    held = s.select(_text("p", k, "/sub/requirements/dev.txt").alias("path"), F.lit("pip_requirements").alias("datasource_id"))
    return asm.requirements_owners(held, packages)


@query("SELECT concat('w', s_suppkey % 10, '/package.json') AS path, concat('m', s_suppkey) AS package_uid FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 4 <> 3")
def workspace_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that a workspace's patterns name and don't take away."""
    s, k = table(spark, sf_dir, "supplier", "s_suppkey"), F.col("s_suppkey")
    folder = _pick("s_suppkey", "packages/bad", "packages/m", "libs/deep/m", "other/m")
    packages = s.select(_text("m", k).alias("package_uid"), F.array(_text("w", k % 10, "/", folder, k, "/package.json")).alias("datafile_paths"))
    spaces = spark.range(10).select(_text("w", F.col("id"), "/package.json").alias("path"), F.array(*map(F.lit, ("packages/*", "libs/**", "!packages/bad*"))).alias("patterns"))
    return asm.workspace_members(spaces, packages)


@query("SELECT DISTINCT concat('root', s_suppkey % 3, '/usr/f', s_suppkey) AS path, concat('u', s_suppkey % 3) AS package_uid FROM supplier WHERE s_suppkey % 3 < 2")
def referenced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that installed packages list."""
    s, k = table(spark, sf_dir, "supplier", "s_suppkey"), F.col("s_suppkey")
    packages = spark.createDataFrame([("u0",), ("u1",)], "package_uid string")
    listed = s.select(_text("u", k % 3).alias("package_uid"), _text("/root", k % 3, "/").alias("root"), _text("/usr/f", k).alias("path"))
    return asm.referenced_files(packages, listed, s.select(_text("root", k % 3, "/usr/f", k).alias("path")))


@query("SELECT concat('pkg:x/d', s_suppkey) AS purl, concat('odd', s_suppkey, '/thing') AS datafile_path FROM supplier WHERE s_suppkey % 2 = 0")
def unassembled_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of manifests that nobody reads or owns."""
    s, k = table(spark, sf_dir, "supplier", "s_suppkey"), F.col("s_suppkey")
    rows = _manifest(s, _text("odd", k, "/thing"), "unlisted", "x", _none(), _text("pkg:x/d", k)).unionByName(_manifest(s, _text("n", k, "/package.json"), "npm_package_json", "npm", _none(), _text("pkg:npm/e", k)))
    owners = s.where("s_suppkey % 2 = 1").select(_text("odd", k, "/thing").alias("path"))
    return asm.unassembled_dependencies(rows, owners).select("purl", "datafile_path")


@query("""
WITH p AS (SELECT concat('pkg:npm/n', s_suppkey % 7) AS purl, concat('n', s_suppkey % 7) AS name, (s_suppkey % 3)::VARCHAR AS version, concat('d', s_suppkey, '/a') AS first FROM supplier)
SELECT purl, name, version, first, row_number() OVER (ORDER BY purl, name, version, first) AS place FROM p
""")
def final_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of packages in a document, by their places in it."""
    s, k = table(spark, sf_dir, "supplier", "s_suppkey"), F.col("s_suppkey")
    packages = s.select(_text("pkg:npm/n", k % 7).alias("purl"), _text("n", k % 7).alias("name"), (k % 3).cast("string").alias("version"), F.array(_text("d", k, "/b"), _text("d", k, "/a"), _text("d", k, "/b")).alias("datafile_paths"))
    ordered, _ = asm.final_order(packages)
    placed = ordered.select("purl", "name", "version", F.get("datafile_paths", F.lit(0)).alias("first")).rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1))
    return spark.createDataFrame(placed, "purl string, name string, version string, first string, place long")


@query("""
SELECT concat('u', s_suppkey) AS package_uid, CASE WHEN s_suppkey % 3 = 1 THEN 2 ELSE 1 END::BIGINT AS files, concat('pkg:npm/d', s_suppkey) AS dependency FROM supplier WHERE s_suppkey % 3 > 0
""")
def trimmed_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages and dependencies of the files that a selection keeps."""
    s, k = table(spark, sf_dir, "supplier", "s_suppkey"), F.col("s_suppkey")
    packages = s.select(_text("u", k).alias("package_uid"), _text("n", k).alias("name"), F.array(_text("d", k, "/a"), _text("d", k, "/b")).alias("datafile_paths"))
    needs = s.select(_text("pkg:npm/d", k).alias("purl"), _text("u", k).alias("for_package_uid"), _text("d", k, "/a").alias("datafile_path"))
    kept = s.where("s_suppkey % 3 > 0").select(_text("d", k, "/a").alias("path")).unionAll(s.where("s_suppkey % 3 = 1").select(_text("d", k, "/b")))
    left, dependencies = tr.trim_assembly(packages, needs, kept)
    return left.join(dependencies, F.col("package_uid") == F.col("for_package_uid")).select("package_uid", F.size("datafile_paths").cast("long").alias("files"), F.col("purl").alias("dependency"))


# Scores and documents ----------------------------------------------------------------------------------------------


@query("SELECT 40 + 10 - 20 - 10 + 10 AS score, true AS declared_license, false AS identification_precision, true AS has_license_text, true AS declared_copyrights, true AS conflicting_license_categories, true AS ambiguous_compound_licensing")
def clarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clarity of key files made from parts (Z6): two licenses, one of low score, a text, a copyright, copyleft elsewhere."""
    p, k = table(spark, sf_dir, "part", "p_partkey"), F.col("p_partkey")
    path = _text("f", k)
    flags = p.select(path.alias("path"), (k % 10 == 0).alias("is_key_file"))
    found = p.select(path.alias("path"), F.when(k % 10 > 0, "gpl-3.0").when(k % 20 == 0, "mit").otherwise("bsd-new").alias("license_expression"), F.when(k % 20 == 0, "text").otherwise("notice").alias("kind"), F.when(k % 20 == 0, 99.0).otherwise(50.0).alias("score"))
    kinds = spark.createDataFrame([("mit", "Permissive"), ("bsd-new", "Permissive"), ("gpl-3.0", "Copyleft")], "license_expression string, category string")
    return sm.clarity(flags, found, p.select(path.alias("path")), kinds)


_JSON_FILE = """concat('{"path":"', source, '/', lang, '/doc_', doc_id, '.txt","type":"file","name":"doc_', doc_id, '.txt","size":', n_chars, ',"sha1":"', sha1(text), '","copyrights":[', CASE WHEN contains(text, 'reserved') THEN '{"copyright":"All rights reserved","start_line":1,"end_line":2}' ELSE '' END, ']}')"""


@query(f"""
WITH f AS (SELECT concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, {_JSON_FILE} AS value FROM documents)
SELECT path, value FROM f
""")
def json_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the whole JSON document, read back from its text (O1)."""
    folder = _folder(spark, "json")
    lines = json_document(report_of(spark, sf_dir))
    lines.where(F.col("value").startswith('{"path":"') | F.col("value").startswith(',{"path":"')).select(F.regexp_replace("value", "^,", "").alias("value")).write.text(folder)
    return spark.read.text(folder).select(F.get_json_object("value", "$.path").alias("path"), "value")


@query("SELECT count(*) AS files, sum(n_chars)::BIGINT AS size, count(*) FILTER (contains(text, 'reserved')) AS copyrights FROM documents")
def yaml_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the YAML document's lines."""
    lines = yaml_document(report_of(spark, sf_dir)).select(F.explode(F.split("value", "\n")).alias("line"))
    own = lambda field: F.regexp_extract("line", rf'^[ -]*"?{field}"?: *"?([^",]*)', 1)
    return lines.agg(
        F.count_if(F.col("line").rlike('^[ -]*"?path"?:')).alias("files"), F.sum(F.nullif(own("size"), F.lit("")).cast("long")).alias("size"), F.count_if(F.col("line").rlike('"?copyright"?: *"?All rights')).alias("copyrights")
    )


@query("SELECT concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, concat('<tr><td>', source, '/', lang, '/doc_', doc_id, '.txt</td><td>file</td><td>doc_', doc_id, '.txt</td><td>', n_chars, '</td><td>', sha1(text), '</td></tr>') AS row FROM documents")
def html_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the page's table of files."""
    lines = html_report(report_of(spark, sf_dir)).where("section = 11")
    return lines.select(F.regexp_extract("value", "^<tr><td>([^<]*)</td>", 1).alias("path"), F.col("value").alias("row"))


@query("SELECT p_partkey, replace(replace(replace(replace(replace(concat('<', p_name, '&', p_brand, '\"''>'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS value FROM part")
def xml_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of markup."""
    return table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", escape_xml(_text("<", F.col("p_name"), "&", F.col("p_brand"), "\"'>")).alias("value"))
