"""Queries over paths, manifests, packages and results. Files and manifests are made from the tables' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly as asm
from ..operators import summary as sm
from ..operators import tree as tr
from ..parsers import package_data, readers_table
from ..sinks import Report, csv_table, cyclonedx_json, json_lines, nest_files
from ..sinks.documents import spdx_files, verification_code
from ..sinks.lines import ordered
from .registry import query, table


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size: documents as files, source/lang/name."""
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("path"), F.col("n_chars").alias("size"), "doc_id", "lang", "source")


FILES = "SELECT concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, n_chars AS size, doc_id, lang, source FROM documents"
_long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.with_directories(files_of(spark, sf_dir).select("path"))


TREE = f"SELECT path, false AS is_dir FROM ({FILES}) UNION ALL SELECT DISTINCT source, true FROM documents UNION ALL SELECT DISTINCT concat(source, '/', lang), true FROM documents"


@query(TREE)
def tree_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and the directories above them."""
    return _tree(spark, sf_dir)


@query("SELECT source AS path, true AS is_dir FROM documents GROUP BY ALL UNION ALL SELECT concat(source, '/', lang), true FROM documents GROUP BY ALL")
def tree_depth_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of 1 lists two levels."""
    return tr.limit_depth(_tree(spark, sf_dir), 1)


@query(f"SELECT path, is_dir FROM ({TREE}) WHERE NOT regexp_matches(path, '(^|/)src1[0-9]*(/|$)') AND NOT regexp_matches(path, '^[^/]+/de(/|$)')")
def tree_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left without two patterns."""
    return tr.exclude(_tree(spark, sf_dir), ["src1*", "*/de"])[0]


@query("SELECT (count(DISTINCT CASE WHEN regexp_matches(source, '^src1') THEN source END) + count(DISTINCT CASE WHEN NOT regexp_matches(source, '^src1') AND lang = 'de' THEN concat(source, '/', lang) END))::BIGINT AS excluded_count FROM documents")
def tree_excluded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topmost excluded paths (S3)."""
    return tr.exclude(_tree(spark, sf_dir), ["src1*", "*/de"])[1]


@query(f"""
WITH f AS (SELECT * FROM ({FILES}) WHERE lang = 'fr' AND regexp_extract(path, '([^/]+)$', 1) NOT LIKE 'doc_1%')
SELECT path, false AS is_dir FROM f UNION ALL
SELECT DISTINCT source, true FROM documents WHERE lang = 'fr' UNION ALL SELECT DISTINCT concat(source, '/', lang), true FROM documents WHERE lang = 'fr'
""")
def tree_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes, then excludes; directories above what matched stay."""
    return tr.include_exclude(_tree(spark, sf_dir), ["*/fr/*"], ["doc_1*"])


@query(f"SELECT count(*) FILTER (NOT is_dir) AS files_count, count(*) FILTER (is_dir) AS directories_count, (SELECT sum(n_chars)::BIGINT FROM documents) AS size_count FROM ({TREE})")
def tree_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a tree."""
    sized = _tree(spark, sf_dir).join(files_of(spark, sf_dir).select("path", "size"), "path", "left").withColumn("type", F.when(F.col("is_dir"), "directory").otherwise("file"))
    return tr.counters(sized)


@query("""
SELECT source AS path, count(*) AS files_count, count(DISTINCT lang) AS dirs_count, sum(n_chars)::BIGINT AS size_count FROM documents GROUP BY source
UNION ALL SELECT concat(source, '/', lang), count(*), 0, sum(n_chars)::BIGINT FROM documents GROUP BY source, lang
""")
def tree_directory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all that is below each directory."""
    sized = _tree(spark, sf_dir).join(files_of(spark, sf_dir).select("path", "size"), "path", "left")
    return tr.directory_counts(sized)


@query("SELECT source AS root FROM documents GROUP BY source ORDER BY length(source), source LIMIT 1")
def tree_scan_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shallowest, then shortest directory."""
    return tr.scan_root(_tree(spark, sf_dir))


@query(f"SELECT path, concat('srv/scan/', path) AS full_path, regexp_replace(path, '^[^/]+/', '') AS stripped FROM ({FILES})")
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below their root, and absolute ones."""
    files = files_of(spark, sf_dir)
    return files.select("path", tr.full_root(F.col("path"), "/srv/scan/").alias("full_path"), tr.strip_root(F.col("path"), F.col("source")).alias("stripped"))


@query(f"""
WITH hit AS (SELECT DISTINCT doc_id FROM documents WHERE contains(text, 'reserved')), f AS (SELECT path, source, lang FROM ({FILES}) JOIN hit USING (doc_id))
SELECT path, false AS is_dir FROM f UNION ALL SELECT DISTINCT source, true FROM f UNION ALL SELECT DISTINCT concat(source, '/', lang), true FROM f
""")
def only_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with findings and what is above them."""
    hit = table(spark, sf_dir, "documents").where(F.col("text").contains("reserved")).select("doc_id")
    facts = files_of(spark, sf_dir).join(hit, "doc_id", "left_semi").select("path")
    return tr.only_findings(_tree(spark, sf_dir), [facts])


@query("SELECT p_partkey FROM part WHERE NOT regexp_matches(p_brand, '#1[0-9]$')")
def ignore_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which no holder matches (R2)."""
    parts = table(spark, sf_dir, "part")
    return tr.drop_matching(parts.select("p_partkey"), parts.select("p_partkey", F.col("p_brand").alias("holder")), "holder", ["#1[0-9]$"], "p_partkey")


@query("SELECT DISTINCT l_orderkey, l_shipmode_ AS value FROM (SELECT l_orderkey, l_returnflag AS l_shipmode_ FROM lineitem)")
def unique_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal findings once."""
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("value"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    return tr.unique_findings(found, "l_orderkey", "value").select("l_orderkey", "value")


@query("""
WITH f AS (SELECT p_brand AS d, concat(p_brand, '/f', p_partkey, CASE WHEN p_size % 10 = 0 THEN '.txt' ELSE '.py' END) AS path, p_size % 10 <> 0 AS src FROM part)
SELECT path, src AS is_source, src::INT::BIGINT AS source_count FROM f UNION ALL SELECT d, sum(src::INT) / count(*) >= 0.9, sum(src::INT)::BIGINT FROM f GROUP BY d
""")
def mark_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of source files."""
    files = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/f"), "p_partkey", F.when(F.col("p_size") % 10 == 0, ".txt").otherwise(".py")).alias("path"))
    return tr.mark_source(tr.with_directories(files).withColumn("is_source", F.col("path").endswith(".py")))


# Manifests and packages --------------------------------------------------------------------------------------------

_PACKAGE = "concat('lib', p_partkey)"
_VERSION = "concat(p_size, '.0.', p_partkey % 7)"


def manifests_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a package.json for each part, with a dependency on the next one's package."""
    version = F.concat("p_size", F.lit(".0."), F.col("p_partkey") % 7)
    content = F.to_json(F.struct(F.concat(F.lit("lib"), "p_partkey").alias("name"), version.cast("string").alias("version"), F.col("p_type").alias("description"), F.lit("MIT").alias("license"), F.create_map(F.concat(F.lit("lib"), F.col("p_partkey") + 1), F.lit("^1.0")).alias("dependencies")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("repo/"), "p_brand", F.lit("/p"), "p_partkey", F.lit("/package.json")).alias("path"), content.alias("content"))


@query(f"""
SELECT concat('repo/', p_brand, '/p', p_partkey, '/package.json') AS path, 'npm' AS type, {_PACKAGE} AS name, {_VERSION} AS version, concat('pkg:npm/', {_PACKAGE}, '@', {_VERSION}) AS purl, p_type AS description, 'mit' AS declared_license_expression,
  concat('pkg:npm/lib', p_partkey + 1) AS dependency, '^1.0' AS requirement FROM part
""")
def npm_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows (section 2.6) of package.json files."""
    rows = package_data(manifests_of(spark, sf_dir))
    first = F.get("dependencies", F.lit(0))
    return rows.select("path", "type", "name", "version", "purl", "description", "declared_license_expression", first["purl"].alias("dependency"), first["extracted_requirement"].alias("requirement"))


@query("""
SELECT concat('c', o_custkey, '/o', o_orderkey, '/requirements.txt') AS path, concat('pkg:pypi/part-', l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN concat('@', l_suppkey, '.0') ELSE '' END) AS purl,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('==', l_suppkey, '.0') ELSE '>=1.0' END AS requirement, l_linenumber % 2 = 0 AS is_pinned FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""")
def requirement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement lines (P10) of a file for each order."""
    line = F.concat(F.lit("Part_"), "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" == "), "l_suppkey", F.lit(".0"))).otherwise(">=1.0  # any"))
    texts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("s"))))["s"], "\n").alias("content"))
    held = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(texts, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = package_data(held.select(F.concat(F.lit("c"), "o_custkey", F.lit("/o"), "o_orderkey", F.lit("/requirements.txt")).alias("path"), "content"))
    return rows.select("path", F.inline("dependencies")).select("path", "purl", F.col("extracted_requirement").alias("requirement"), "is_pinned")


@query()
def package_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of manifest readers (Appendices B and C): the library's own, whatever the tables hold."""
    return readers_table(spark).select("datasource_id", "type", "paths")


def _package_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest and lock rows: a manifest for each order, and a lock beside it that disagrees for every fifth."""
    orders = table(spark, sf_dir, "orders")
    folder = F.concat(F.lit("ws/c"), "o_custkey", F.lit("/o"), "o_orderkey")
    name, version = F.concat(F.lit("pkg"), "o_orderkey"), F.lit("1.0.0")
    dependency = F.array(F.struct(F.concat(F.lit("pkg:npm/dep"), F.col("o_custkey")).alias("purl"), F.lit("^1").alias("extracted_requirement"), F.lit("dependencies").alias("scope")))
    url = lambda n: F.concat(F.lit("pkg:npm/"), n, F.lit("@"), version)
    row = lambda file, source, n, v, d: orders.select(F.concat(folder, F.lit(f"/{file}")).alias("path"), F.lit(source).alias("datasource_id"), F.lit("npm").alias("type"), F.lit(None).cast("string").alias("namespace"), n.alias("name"), version.alias("version"), url(n).alias("purl"), v.alias("description"), d.alias("dependencies"))
    other = F.when(F.col("o_orderkey") % 5 == 0, F.lit("another")).otherwise(name)
    return row("package.json", "npm_package_json", name, F.lit(None).cast("string"), dependency).unionByName(row("package-lock.json", "npm_package_lock_json", other, F.col("o_orderpriority"), dependency))


@query("""
SELECT concat('ws/c', o_custkey, '/o', o_orderkey) AS parent_path, concat('pkg', o_orderkey) AS name, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS description, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END::BIGINT AS n_files FROM orders
""")
def sibling_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests and locks of a directory as one package."""
    packages, _ = asm.sibling_packages(_package_rows(spark, sf_dir))
    return packages.select("parent_path", "name", "description", F.size("datafile_paths").cast("long").alias("n_files"))


@query("SELECT concat('pkg:npm/dep', o_custkey) AS purl, count(*) + sum((o_orderkey % 5 <> 0)::INT)::BIGINT AS n FROM orders GROUP BY o_custkey")
def hoisted_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of the manifests that made packages (A3)."""
    _, dependencies = asm.sibling_packages(_package_rows(spark, sf_dir))
    return dependencies.groupBy("purl").agg(F.count(F.lit(1)).alias("n"))


def _nested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Packages at customers and at their orders, and a file for each line of an order, some in node_modules."""
    customers, orders, lines = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    made = lambda df, folder, name: df.select(F.lit("npm").alias("type"), F.array(F.concat(folder, F.lit("/package.json"))).alias("datafile_paths"), name.alias("package_uid"))
    packages = made(customers, F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("c"), "c_custkey")).unionByName(made(orders.where("o_orderkey % 2 = 0"), F.concat(F.lit("c"), "o_custkey", F.lit("/o"), "o_orderkey"), F.concat(F.lit("o"), "o_orderkey")))
    inside = F.when(F.col("l_linenumber") == 1, "node_modules/").otherwise("src/")
    files = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey", F.lit("/o"), "o_orderkey", F.lit("/"), inside, F.lit("f"), "l_linenumber", F.lit(".js")).alias("path"))
    return packages, files


@query("""
WITH f AS (SELECT DISTINCT o_orderkey, o_custkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'node_modules/' ELSE 'src/' END AS inside FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT concat('c', o_custkey, '/o', o_orderkey, '/', inside, 'f', l_linenumber, '.js') AS path, CASE WHEN o_orderkey % 2 = 0 AND inside = 'src/' THEN concat('o', o_orderkey) ELSE concat('c', o_custkey) END AS package_uid
FROM f WHERE o_custkey IN (SELECT c_custkey FROM customer) OR (o_orderkey % 2 = 0 AND inside = 'src/')
""")
def npm_owned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest root owns a file, but not what is in its node_modules."""
    packages, files = _nested(spark, sf_dir)
    return asm.owned_files(files, packages, "npm")


@query("""
WITH f AS (SELECT DISTINCT o_orderkey, o_custkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'target/' ELSE 'src/' END AS inside FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT concat('c', o_custkey, '/o', o_orderkey, '/', inside, 'f', l_linenumber, '.rs') AS path, unnest(list_filter([CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN concat('c', o_custkey) END, CASE WHEN o_orderkey % 2 = 0 AND inside = 'src/' THEN concat('o', o_orderkey) END], lambda x: x IS NOT NULL)) AS package_uid FROM f
""")
def cargo_owned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every root above owns a file, but for its target folder."""
    packages, files = _nested(spark, sf_dir)
    renamed = packages.select(F.lit("cargo").alias("type"), F.transform("datafile_paths", lambda p: F.replace(p, F.lit("package.json"), F.lit("Cargo.toml"))).alias("datafile_paths"), "package_uid")
    moved = files.select(F.replace(F.replace("path", F.lit("node_modules/"), F.lit("target/")), F.lit(".js"), F.lit(".rs")).alias("path"))
    return asm.owned_files(moved, renamed, "cargo")


@query("""
WITH r AS (SELECT concat('s', p_size, '/', p_brand, '/p.csproj') AS path, p_brand AS name, p_size FROM part GROUP BY ALL)
SELECT r.path, r.name, CASE WHEN p_size % 2 = 0 THEN concat('deep-', p_size) ELSE 'top' END AS version FROM r
""")
def central_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the nearest central file above."""
    parts = table(spark, sf_dir, "part")
    references = parts.select(F.concat(F.lit("s"), "p_size", F.lit("/"), "p_brand", F.lit("/p.csproj")).alias("path"), F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("version")).distinct()
    top = parts.select(F.lit("Directory.Packages.props").alias("path"), F.col("p_brand").alias("name"), F.lit("top").alias("version")).distinct()
    deep = parts.where("p_size % 2 = 0").select(F.concat(F.lit("s"), "p_size", F.lit("/Directory.Packages.props")).alias("path"), F.col("p_brand").alias("name"), F.concat(F.lit("deep-"), "p_size").alias("version")).distinct()
    return asm.nearest_versions(references, top.unionByName(deep))


# Summaries ---------------------------------------------------------------------------------------------------------

_FACET_RULES = [("tests", "*/de/*"), ("docs", "doc_1*"), ("data", "src3")]


@query(f"""
SELECT path, CASE WHEN len(f) > 0 THEN array_to_string(f, ',') ELSE 'core' END AS facets FROM (
  SELECT path, list_filter([CASE WHEN lang = 'de' THEN 'tests' END, CASE WHEN regexp_matches(path, '/doc_1[^/]*$') THEN 'docs' END, CASE WHEN source = 'src3' THEN 'data' END], lambda x: x IS NOT NULL) AS f FROM ({FILES}))
""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of files."""
    return sm.facets(files_of(spark, sf_dir).select("path"), _FACET_RULES).select("path", F.array_join("facets", ",").alias("facets"))


@query("""
WITH f AS (SELECT doc_id, lang, unnest(CASE WHEN len(x) > 0 THEN x ELSE ['core'] END) AS facet FROM (SELECT doc_id, lang, list_filter([CASE WHEN lang = 'de' THEN 'tests' END, CASE WHEN doc_id::VARCHAR LIKE '1%' THEN 'docs' END, CASE WHEN source = 'src3' THEN 'data' END], lambda y: y IS NOT NULL) AS x FROM documents)),
pos(facet_pos, facet) AS (VALUES (0, 'core'), (1, 'dev'), (2, 'tests'), (3, 'docs'), (4, 'data'), (5, 'examples'))
SELECT facet_pos::BIGINT AS facet_pos, pos.facet, CASE WHEN lang IS NOT NULL THEN 'language' END AS attribute, lang AS value, count(lang) AS count FROM pos LEFT JOIN f USING (facet) GROUP BY ALL
""")
def tallies_by_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by facet in the fixed order."""
    files = files_of(spark, sf_dir)
    out = sm.tallies_by_facet(files, sm.facets(files.select("path"), _FACET_RULES), {"language": (files, "lang")})
    return out.select(*_long("facet_pos"), "facet", "attribute", "value", "count")


@query("""
SELECT 'language' AS attribute, lang AS value, count(*) AS count FROM documents GROUP BY lang
UNION ALL SELECT 'quality', quality::VARCHAR, count(*) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality
""")
def tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of values, with null for files without one (Z3)."""
    files = files_of(spark, sf_dir)
    labelled = files.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return sm.tallies(files.select("path"), {"language": (files, "lang"), "quality": (labelled, "quality")})


@query("SELECT source AS path, lang AS value, count(*) AS count FROM documents GROUP BY ALL")
def tallies_with_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by resource."""
    rows = files_of(spark, sf_dir).select(F.col("source").alias("path"), F.col("lang").alias("value"))
    return sm.detailed_tallies({"language": (rows, "value")}).select("path", "value", "count")


_NAMES = ("LICENSE", "README.md", "package.json", "CHANGELOG.md", "main.c", "COPYING.txt", "notes.txt")


@query(f"""
WITH f AS (SELECT DISTINCT concat(CASE WHEN n_regionkey = 0 THEN '' ELSE concat('r', n_regionkey, '/') END, name) AS path, name, n_regionkey = 0 AS top FROM nation, (SELECT unnest([{', '.join(repr(n) for n in _NAMES)}]) AS name))
SELECT path, name IN ('LICENSE', 'COPYING.txt') AS is_legal, name = 'README.md' AS is_readme, name = 'package.json' AS is_manifest, name = 'CHANGELOG.md' AS is_community, top AS is_top_level, top AND name IN ('LICENSE', 'COPYING.txt', 'README.md', 'package.json') AS is_key_file FROM f
""")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal, readme, manifest, community, top-level and key files."""
    names = F.explode(F.array(*[F.lit(n) for n in _NAMES])).alias("name")
    files = table(spark, sf_dir, "nation").select("n_regionkey", names)
    folder = F.when(F.col("n_regionkey") == 0, "").otherwise(F.concat(F.lit("r"), "n_regionkey", F.lit("/")))
    return sm.classify(files.select(F.concat(folder, "name").alias("path")).distinct())


@query("""
WITH l AS (SELECT lang AS v, count(*) AS n FROM documents GROUP BY lang), best AS (SELECT v FROM l ORDER BY n DESC, v LIMIT 1)
SELECT (SELECT v FROM best) AS primary_language, (SELECT count(*) FROM l) - 1 AS others, (SELECT sum(n)::BIGINT FROM l WHERE v <> (SELECT v FROM best)) AS other_files
""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary language and the others with their counts."""
    files = files_of(spark, sf_dir)
    none = spark.createDataFrame([], "path string, license_expression string, holder string, declared_license_expression string")
    flags = files.select("path", F.lit(False).alias("is_key_file"))
    out = sm.summary(flags, none, none, none, files.select("path", F.col("lang").alias("programming_language")))
    return out.select("primary_language", F.size("other_languages").cast("long").alias("others"), F.aggregate("other_languages", F.lit(0).cast("long"), lambda n, x: n + x["count"]).alias("other_files"))


@query("""
SELECT source AS facet, lang AS programming_language, count(*) AS count, grouping_id(source, lang)::BIGINT AS level FROM documents GROUP BY CUBE (source, lang)
""")
def facet_language_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: counts by facet, by language, by both and over all."""
    files = files_of(spark, sf_dir)
    return sm.facet_language_cube(files.select("path", F.array("source").alias("facets")), files.select("path", F.col("lang").alias("programming_language")))


# Documents ---------------------------------------------------------------------------------------------------------


def report_of(spark: SparkSession, sf_dir: str) -> Report:
    """Documents as files, with a copyright found in those that reserve rights; parts as packages."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".txt"))
    files = docs.select(path.alias("path"), F.lit("file").alias("type"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("name"), F.col("n_chars").alias("size"), F.sha1(F.col("text").cast("binary")).alias("sha1"))
    found = docs.where(F.col("text").contains("reserved")).select(path.alias("path"), F.lit("All rights reserved").alias("copyright"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    parts = table(spark, sf_dir, "part")
    packages = parts.select(F.concat(F.lit("pkg:generic/lib"), "p_partkey").alias("purl"), F.concat(F.lit("lib"), "p_partkey").alias("name"), F.col("p_size").cast("string").alias("version"), F.col("p_type").alias("description"))
    return Report(spark, nest_files(files, {"copyrights": found}), {"end_timestamp": "2024-01-01T00:00:00Z"}, packages)


@query("""
SELECT 'info' AS kind, concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, concat('doc_', doc_id, '.txt') AS name, n_chars::VARCHAR AS size, '' AS copyright, '' AS start_line FROM documents
UNION ALL SELECT 'copyright', concat(source, '/', lang, '/doc_', doc_id, '.txt'), '', '', 'All rights reserved', '1' FROM documents WHERE contains(text, 'reserved')
""")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table of the CSV writer (O3)."""
    return csv_table(report_of(spark, sf_dir)).select("kind", "path", "name", "size", "copyright", "start_line")


@query("SELECT sha1(string_agg(sha1(text), '' ORDER BY sha1(text))) AS code FROM documents")
def spdx_verification_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package verification code."""
    return verification_code(spdx_files(report_of(spark, sf_dir)))


@query("""
SELECT concat('{"files":[{"path":"', source, '/', lang, '/doc_', doc_id, '.txt","type":"file","name":"doc_', doc_id, '.txt","size":', n_chars, ',"sha1":"', sha1(text), '","copyrights":[', CASE WHEN contains(text, 'reserved') THEN '{"copyright":"All rights reserved","start_line":1,"end_line":2}' ELSE '' END, ']}]}') AS value FROM documents
""")
def json_lines_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File lines of the JSON Lines writer (O2)."""
    return ordered(json_lines(report_of(spark, sf_dir)).where(F.col("section") == 90))


@query("""
SELECT concat(CASE WHEN p_partkey = (SELECT min_by(p_partkey, concat('pkg:generic/lib', p_partkey)) FROM part) THEN '' ELSE ',' END, '{"type":"library","bom-ref":"pkg:generic/lib', p_partkey, '","name":"lib', p_partkey, '","version":"', p_size, '","description":"', p_type, '","scope":"required","purl":"pkg:generic/lib', p_partkey, '"}') AS value FROM part
""")
def cyclonedx_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component lines of the CycloneDX writer."""
    return ordered(cyclonedx_json(report_of(spark, sf_dir)).where(F.col("section") == 3))
