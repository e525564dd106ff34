"""Queries over texts: lines, hashes, generated code, e-mails, URLs, copyright hints, licenses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions import text as tx
from ..operators import copyright as cr
from ..operators import finder as fd
from ..operators import license as lic
from ..operators import rules as rl
from .registry import query, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "html", "url")


_quote = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda items: ", ".join(_quote(s) for s in items)

# Lines as ``text.lines`` has them: no line after a last LF, and one CR before an LF dropped.
LINES = """
SELECT doc_id, i AS line, CASE WHEN i < n AND ends_with(s, chr(13)) THEN s[:-2] ELSE s END AS s FROM (
  SELECT doc_id, n, unnest(range(1, n + 1)) AS i, unnest(parts) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)
) WHERE NOT (i = n AND s = '')
"""


@query(f"SELECT doc_id, count(*) AS n_lines, max(length(s)) AS longest, sum(CASE WHEN s = '' THEN 1 ELSE 0 END)::BIGINT AS n_empty FROM ({LINES}) GROUP BY doc_id")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line model."""
    lines = tx.explode_lines(_documents(spark, sf_dir), "text", "doc_id")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("text_line")).cast("long").alias("longest"), F.count_if(F.col("text_line") == "").alias("n_empty"))


@query("SELECT doc_id, sha1(text) AS sha1, md5(text) AS md5, sha256(text) AS sha256, sha1(concat('blob ', strlen(text), chr(0), text)) AS sha1_git FROM documents")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes."""
    return _documents(spark, sf_dir).select("doc_id", *tx.content_hashes(F.col("text").cast("binary")))


_PHRASES = " OR ".join(f"contains(h, {_quote(p)})" for p in tx.GENERATED_PHRASES)


_GENERATED = "CASE doc_id % 5 WHEN 0 THEN concat('// Code AUTOMATICALLY GENERATED', chr(10), text) WHEN 1 THEN concat(repeat(chr(10), 149 + (doc_id % 2)::INT), 'Do not edit this file') ELSE text END"


@query(f"""
WITH d AS (SELECT doc_id, {_GENERATED} AS text FROM documents), l AS (SELECT doc_id, line, lower(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS h FROM ({LINES.replace('FROM documents', 'FROM d')}) WHERE line <= 150)
SELECT doc_id, min(line) AS first_line, count(*) AS n_hints FROM l WHERE {_PHRASES} GROUP BY doc_id
""")
def generated_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that say a text is generated (P5), with their numbers; the tables have none, so that some are put in front."""
    k = F.col("doc_id") % 5
    late = F.concat(F.repeat(F.lit("\n"), (149 + F.col("doc_id") % 2).cast("int")), F.lit("Do not edit this file"))
    text = F.when(k == 0, F.concat(F.lit("// Code AUTOMATICALLY GENERATED\n"), "text")).when(k == 1, late).otherwise(F.col("text"))
    lines = tx.explode_lines(_documents(spark, sf_dir).select("doc_id", text.alias("text")), "text", "doc_id").where(F.col("line") <= tx.GENERATED_LINES)
    hit = lines.where(F.size(tx.generated_hints(F.col("text_line"))) > 0)
    return hit.groupBy("doc_id").agg(F.min("line").cast("long").alias("first_line"), F.count(F.lit(1)).alias("n_hints"))


_EXTENSIONS = [f"('{e}', '{name.replace(chr(39), '')}')" for name, exts in tx.LANGUAGE_EXTENSIONS.items() for e in exts.split()]


@query(f"""
WITH names AS (SELECT p_partkey, ['py','rs','c','h','java','md','xml','txt','unknown','ts'][1 + p_partkey % 10] AS e FROM part),
kinds(e, language) AS (VALUES {', '.join(_EXTENSIONS)})
SELECT coalesce(language, 'Text') AS language, n.e IN ({_list(sorted(tx.SOURCE_EXTENSIONS))}) AS is_source, count(*) AS files FROM names n LEFT JOIN kinds k ON n.e = k.e GROUP BY ALL
""")
def programming_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages and source flags (P3, P4) of files named after parts."""
    kinds = F.array(*[F.lit(e) for e in "py rs c h java md xml txt unknown ts".split()])
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("parts/p"), "p_partkey", F.lit("."), F.get(kinds, (F.col("p_partkey") % 10).cast("int"))).alias("path"), F.col("p_name").cast("binary").alias("content"))
    return files.select(tx.language(F.col("path"), F.col("content")).alias("language"), tx.is_source(F.col("path")).alias("is_source")).groupBy("language", "is_source").agg(F.count(F.lit(1)).alias("files"))


# E-mails, URLs -----------------------------------------------------------------------------------------------------

_EMAILS = f"""
SELECT doc_id, line, lower(unnest(regexp_extract_all(s, '(?i)\\b[A-Z0-9._%-]+@[A-Z0-9.-]+\\.[A-Z]{{2,63}}\\b'))) AS value, generate_subscripts(regexp_extract_all(s, '(?i)\\b[A-Z0-9._%-]+@[A-Z0-9.-]+\\.[A-Z]{{2,63}}\\b'), 1) - 1 AS pos
FROM ({LINES}) WHERE contains(s, '@')
"""
_HOST = "regexp_extract(value, '@([^@]*)$', 1)"
_HOLDS = lambda v, parts: "(" + " OR ".join(f"contains({v}, {_quote(p)})" for p in parts) + ")"
_ENDS = lambda v, ends: "(" + " OR ".join(f"ends_with({v}, {_quote(e)})" for e in ends) + ")"


@query(_EMAILS)
def email_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address as found (F1)."""
    return fd.email_candidates(_documents(spark, sf_dir), "doc_id").select("doc_id", F.col("line").cast("long").alias("line"), "value", F.col("pos").cast("long").alias("pos"))


_REJECTED = f"""
CASE WHEN {_HOLDS(_HOST, fd.JUNK_HOST_PARTS)} OR {_ENDS(_HOST, fd.IMAGE_SUFFIXES)} OR NOT contains({_HOST}, '.') THEN 'host'
     WHEN {_HOST} IN ({_list(fd.JUNK_MAIL_DOMAINS)}) THEN 'junk-domain' WHEN {_HOLDS('value', fd.JUNK_EMAIL_PARTS)} THEN 'junk-text' WHEN {_ENDS('value', fd.IMAGE_SUFFIXES)} THEN 'image-suffix' END
"""


@query(f"SELECT {_REJECTED} AS rejection, {_HOST} AS host, count(*) AS n FROM ({_EMAILS}) GROUP BY ALL")
def email_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why addresses are dropped."""
    found = fd.email_candidates(_documents(spark, sf_dir), "doc_id")
    return found.groupBy("rejection", F.substring_index("value", "@", -1).alias("host")).agg(F.count(F.lit(1)).alias("n"))


# The junk filter drops every address of these tables, so that hosts are given other names first.
@query(f"""
WITH d AS (SELECT doc_id, replace(replace(replace(text, 'example.com', 'mail.corp'), 'example.org', 'mail.corp'), 'example.net', 'mail.corp') AS text FROM documents),
found AS ({_EMAILS.replace('FROM documents', 'FROM d').replace(LINES, LINES.replace('FROM documents', 'FROM d'))}),
firsts AS (SELECT doc_id, value, line, pos FROM found WHERE ({_REJECTED}) IS NULL QUALIFY row_number() OVER (PARTITION BY doc_id, value ORDER BY line, pos) = 1)
SELECT doc_id, value AS email, line AS start_line, line AS end_line FROM firsts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line, pos) <= 50
""")
def find_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that stay, once each, 50 a text."""
    text = F.col("text")
    for host in ("example.com", "example.org", "example.net"):
        text = F.replace(text, F.lit(host), F.lit("mail.corp"))
    return fd.find_emails(_documents(spark, sf_dir).select("doc_id", text.alias("text")), "doc_id").select("doc_id", "email", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query("""
WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages WHERE regexp_matches(url, '^(?:http|https)://'))
SELECT scheme, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS domain, count(*) AS pages FROM u GROUP BY ALL
""")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL candidates of pages (F4, F5) by scheme and domain."""
    found = fd.url_candidates(_pages(spark, sf_dir), "page_id", "url").where(F.col("pos") == 0)
    domain = F.regexp_extract(F.regexp_extract("value", r"^[a-z]+://([^/?#]*)", 1), r"([^.]+[.][^.]+)$", 1)
    return found.groupBy(F.regexp_extract("value", r"^([a-z]+)://", 1).alias("scheme"), domain.alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT page_id, replace(url, 'example.', 'site.') AS url, 1::BIGINT AS start_line, 1::BIGINT AS end_line FROM pages WHERE regexp_matches(url, '^https?://')")
def find_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs (F5 to F10) of pages, with hosts that the junk filter leaves alone."""
    moved = _pages(spark, sf_dir).select("page_id", F.replace("url", F.lit("example."), F.lit("site.")).alias("url"))
    return fd.find_urls(moved, "page_id", "url").select("page_id", "url", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


# Copyrights --------------------------------------------------------------------------------------------------------

_HINTS = " OR ".join(f"contains(lower(s), {_quote(m)})" for m in cr.MARKERS)
_C_SIGN = "regexp_matches(regexp_extract(s, '(?i)(?:^|[^a-z0-9])[(]c[)][ \\t\\n\\f\\r\\x0B]*([^ \\t\\n\\f\\r\\x0B])', 1), '^[0-9A-Z]$')"
_YEARS = "regexp_matches(s, '[(.,\\-)\\s](?:19[6-9][0-9]|20[0-9]{2})(?:[(.,\\-)\\s]|$)')"


@query(f"SELECT ({_HINTS} OR {_C_SIGN}) AS has_hint, ({_YEARS}) AS has_year, count(*) AS n FROM ({LINES}) GROUP BY ALL")
def copyright_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by what makes them candidates."""
    lines = tx.explode_lines(_documents(spark, sf_dir), "text", "doc_id")
    return lines.groupBy(cr.has_hint(F.col("text_line")).alias("has_hint"), cr.has_year(F.col("text_line")).alias("has_year")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH l AS (SELECT doc_id, line FROM ({LINES}) WHERE ({_HINTS} OR {_C_SIGN} OR {_YEARS}) AND NOT regexp_matches(s, '^M[\\x20-\\x60]{{60}}$') AND NOT regexp_matches(s, '^[A-Za-z0-9+/]{{60,}}={{0,2}}$')
  AND (length(s) <= 2000 OR regexp_matches(lower(s), 'copyright|[(]c[)]|©|&copy'))),
g AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM l)
SELECT doc_id, min(line) AS first_line, max(line) AS last_line, count(*) AS n FROM g GROUP BY doc_id, island
""")
def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of candidate lines."""
    groups = cr.candidate_groups(_documents(spark, sf_dir), "doc_id")
    return groups.groupBy("doc_id", "group_id").agg(F.min("line").cast("long").alias("first_line"), F.max("line").cast("long").alias("last_line"), F.count(F.lit(1)).alias("n")).drop("group_id")


_NOTICE = "concat('Copyright (c) ', 1990 + p_partkey % 30, ' ', CASE p_partkey % 3 WHEN 0 THEN 'Jane Doe' WHEN 1 THEN 'Acme Corporation' ELSE 'Example Foundation' END)"


@query(f"""
WITH n AS (SELECT p_partkey, {_NOTICE} AS c FROM part)
SELECT p_partkey, 'copyright' AS kind, c AS value FROM n UNION ALL SELECT p_partkey, 'holder', regexp_extract(c, '[0-9]{{4}} (.*)$', 1) FROM n
UNION ALL SELECT p_partkey, 'author', 'John Smith' FROM part WHERE p_partkey % 5 = 0
""")
def copyright_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements, holders and authors (C10 to C19) of headers made from parts."""
    holder = F.when(F.col("p_partkey") % 3 == 0, "Jane Doe").when(F.col("p_partkey") % 3 == 1, "Acme Corporation").otherwise("Example Foundation")
    head = F.concat(F.lit("/* Copyright (c) "), (1990 + F.col("p_partkey") % 30).cast("string"), F.lit(" "), holder, F.lit("\n */\nint main() {}\n"), F.when(F.col("p_partkey") % 5 == 0, "// Written by John Smith\n").otherwise(""))
    return cr.detect_copyrights(table(spark, sf_dir, "part").select("p_partkey", head.alias("text")), "p_partkey").select("p_partkey", "kind", "value")


@query("""
SELECT c_custkey, trim(concat(c_name, ' ', lower(replace(c_name, '#', '')), '@corp.io')) AS author, 2::BIGINT AS start_line, 3::BIGINT AS end_line FROM customer
UNION ALL SELECT c_custkey, 'Second', 5, 5 FROM customer WHERE c_nationkey % 2 = 0
""")
def credits_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of credits files (C20) made from customers."""
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@corp.io"))
    text = F.concat(F.lit("\nN: "), "c_name", F.lit("\nE: "), mail, F.lit("\n\n"), F.when(F.col("c_nationkey") % 2 == 0, "N: Second\n").otherwise("none\n"))
    found = cr.credits_authors(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey")
    return found.select("c_custkey", "author", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


# Licenses ----------------------------------------------------------------------------------------------------------

_TOKENS = lambda s: f"list_filter(regexp_extract_all(lower({s}), '[a-z0-9]+\\+?[a-z0-9]*'), lambda x: x NOT IN ({_list(sorted(lic.STOPWORDS))}))"
_RULES = ", ".join(f"({n}, {_quote(e)}, {_quote(k)}, {_quote(t)}, {r})" for n, (_, e, k, t, r) in enumerate(rl.DEFAULT_RULES))

# tokens: idx from 0 over a document; matches: every place where a rule's tokens stand; kept: those not inside others.
MATCHES = f"""
rules AS (SELECT rid, expression, kind, {_TOKENS('body')} AS toks, relevance FROM (VALUES {_RULES}) AS r(rid, expression, kind, body, relevance)),
rule_tokens AS (SELECT rid, unnest(range(0, len(toks))) AS pos, unnest(toks) AS tok, len(toks) AS n FROM rules),
lines AS ({LINES}),
pieces AS (SELECT doc_id, line, unnest({_TOKENS('s')}) AS tok, generate_subscripts({_TOKENS('s')}, 1) AS place FROM lines),
tokens AS (SELECT doc_id, line, tok, row_number() OVER (PARTITION BY doc_id ORDER BY line, place) - 1 AS idx FROM pieces),
matches AS (
  SELECT doc_id, rid, idx - pos AS start_token, idx - pos + n AS end_token, n AS matched_length, min(line) AS start_line, max(line) AS end_line
  FROM tokens JOIN rule_tokens USING (tok) GROUP BY doc_id, rid, idx - pos, n HAVING count(*) = n
),
kept AS (
  SELECT m.*, expression, kind, relevance FROM (
    SELECT *, max(end_token) OVER (PARTITION BY doc_id ORDER BY start_token, end_token DESC, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM matches
  ) m JOIN rules USING (rid) WHERE far IS NULL OR end_token > far
)
"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches of whole texts, those inside others left out."""
    return lic.without_contained(lic.exact_matches(_documents(spark, sf_dir), rl.default_rules(spark), "doc_id"), "doc_id")


_long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]


@query(f"WITH {MATCHES} SELECT expression AS license_expression, kind, count(*) AS matches, count(DISTINCT doc_id) AS documents FROM kept GROUP BY ALL")
def license_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest whole query: texts to lines to tokens to rule matches to tallies."""
    return _matches(spark, sf_dir).groupBy("license_expression", "kind").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("doc_id").alias("documents"))


@query(f"WITH {MATCHES} SELECT doc_id, rid, start_token, end_token, matched_length, start_line, end_line FROM matches")
def license_exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place, overlapping ones too."""
    found = lic.exact_matches(_documents(spark, sf_dir), rl.default_rules(spark), "doc_id")
    return found.select("doc_id", *_long("rid", "start_token", "end_token", "matched_length", "start_line", "end_line"))


@query(f"WITH {MATCHES} SELECT doc_id, rid, start_token, end_token, matched_length, start_line, end_line FROM matches")
def license_automaton_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same places by one automaton over all rules."""
    found = lic.automaton_matches(_documents(spark, sf_dir), rl.default_rules(spark), "doc_id")
    return found.select("doc_id", *_long("rid", "start_token", "end_token", "matched_length", "start_line", "end_line"))


@query(f"""
WITH {MATCHES}, whole AS (SELECT doc_id, line, {_TOKENS('s')} AS toks FROM lines)
SELECT concat(w.doc_id, ':', w.line) AS line_id, r.rid, r.expression AS license_expression, len(w.toks) AS matched_length FROM whole w JOIN rules r ON w.toks = r.toks
""")
def license_hash_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are a rule as a whole."""
    lines = tx.explode_lines(_documents(spark, sf_dir), "text", "doc_id").select(F.concat_ws(":", "doc_id", "line").alias("line_id"), F.col("text_line").alias("text"))
    found = lic.hash_matches(lines, rl.default_rules(spark), "line_id")
    return found.select("line_id", *_long("rid"), "license_expression", *_long("matched_length"))


@query(f"""
WITH {MATCHES}, marked AS (
  SELECT *, CASE WHEN start_line - max(end_line) OVER (PARTITION BY doc_id ORDER BY start_line, start_token, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 4 THEN 1 ELSE 0 END AS fresh FROM kept WHERE kind <> 'clue'
), islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start_line, start_token, rid) AS detection FROM marked)
SELECT doc_id, detection::BIGINT AS detection, min(start_line) AS start_line, max(end_line) AS end_line, array_to_string(list_distinct_ordered, ' AND ') AS license_expression, n AS matches, 100.0::DOUBLE AS coverage FROM (
  SELECT doc_id, detection, start_line, end_line, list(expression) OVER (PARTITION BY doc_id, detection ORDER BY start_token, rid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e,
    list_filter(e, lambda x, i: list_position(e, x) = i) AS list_distinct_ordered, count(*) OVER (PARTITION BY doc_id, detection) AS n FROM islands
) GROUP BY ALL
""".replace("GROUP BY ALL", "GROUP BY doc_id, detection, list_distinct_ordered, n"))
def license_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches near one another as detections, with their coverage."""
    found = lic.detections(lic.split_clues(_matches(spark, sf_dir))[0], "doc_id")
    return found.select("doc_id", *_long("detection", "start_line", "end_line"), "license_expression", F.size("matches").cast("long").alias("matches"), "coverage")


@query(f"WITH {MATCHES} SELECT expression AS identifier, expression AS license_expression, count(*) AS detection_count, min(doc_id) AS first_document FROM kept GROUP BY ALL")
def license_unique_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal detections over all texts."""
    found = _matches(spark, sf_dir).withColumn("identifier", F.col("license_expression"))
    return lic.unique_detections(found, key="doc_id").select("identifier", "license_expression", "detection_count", F.col("first_region.path").alias("first_document"))


@query(f"WITH {MATCHES} SELECT kind = 'clue' AS is_clue, count(*) AS n FROM kept GROUP BY ALL")
def license_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections and clues."""
    found, clues = lic.split_clues(_matches(spark, sf_dir))
    counted = lambda df, clue: df.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(clue).alias("is_clue"), "n")
    return counted(found, False).unionByName(counted(clues, True))


_LEGALESE = _list(sorted(lic.LEGALESE))


@query(f"WITH {MATCHES} SELECT doc_id, tok AS token, count(*) AS n FROM tokens WHERE tok IN ({_LEGALESE}) GROUP BY ALL")
def license_legalese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of tokens that mark license text (L2 to L4)."""
    return lic.high_value(lic.token_counts(_documents(spark, sf_dir), "doc_id"))


@query(f"""
WITH {MATCHES}, counts AS (SELECT doc_id, tok, count(*) AS n FROM tokens GROUP BY ALL), sizes AS (SELECT doc_id, sum(n) AS length FROM counts GROUP BY ALL),
rc AS (SELECT rid, tok, count(*) AS rn FROM rule_tokens GROUP BY ALL), rs AS (SELECT rid, sum(rn) AS rlength FROM rc GROUP BY ALL),
pairs AS (SELECT doc_id, rid, sum(least(n, rn))::BIGINT AS shared, max(tok IN ({_LEGALESE})) AS legal FROM counts JOIN rc USING (tok) GROUP BY ALL),
scored AS (SELECT doc_id, rid, shared, round(shared / rlength, 6) AS containment, round(shared / (length + rlength - shared), 6) AS resemblance FROM pairs JOIN sizes USING (doc_id) JOIN rs USING (rid) WHERE legal)
SELECT doc_id, rid, shared, containment, resemblance, row_number() OVER (PARTITION BY doc_id ORDER BY resemblance DESC, containment DESC, rid) AS rank FROM scored QUALIFY rank <= 3
""")
def license_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three rules of each text that are most like it (L5, L8): a top-k report."""
    found = lic.candidate_rules(_documents(spark, sf_dir), rl.default_rules(spark), "doc_id", most=3)
    return found.select("doc_id", *_long("rid", "shared"), "containment", "resemblance", *_long("rank"))


@query(f"""
WITH {MATCHES}, lt AS (SELECT concat(doc_id, ':', line) AS line_id, tok, count(*) AS n FROM tokens GROUP BY ALL), ls AS (SELECT line_id, sum(n) AS length FROM lt GROUP BY ALL),
rc AS (SELECT rid, tok, count(*) AS rn FROM rule_tokens GROUP BY ALL), rs AS (SELECT rid, sum(rn) AS rlength FROM rc GROUP BY ALL),
pairs AS (SELECT line_id, rid, sum(least(n, rn)) AS shared, max(tok IN ({_LEGALESE})) AS legal FROM lt JOIN rc USING (tok) GROUP BY ALL),
scored AS (SELECT line_id, rid, round(shared / (length + rlength - shared), 6) AS resemblance, round(shared / rlength, 6) AS containment FROM pairs JOIN ls USING (line_id) JOIN rs USING (rid) WHERE legal)
SELECT line_id, rid, resemblance FROM scored WHERE resemblance >= 0.8 QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY resemblance DESC, containment DESC, rid) <= 10
""")
def license_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are nearly a rule (L8 at its threshold, ten a line)."""
    lines = tx.explode_lines(_documents(spark, sf_dir), "text", "doc_id").select(F.concat_ws(":", "doc_id", "line").alias("line_id"), F.col("text_line").alias("text"))
    return lic.near_duplicate_rules(lines, rl.default_rules(spark), "line_id").select("line_id", *_long("rid"), "resemblance")


@query(f"""
WITH {MATCHES}, covered AS (SELECT DISTINCT doc_id, idx FROM tokens JOIN kept USING (doc_id) WHERE idx >= start_token AND idx < end_token), n AS (SELECT doc_id, count(*) AS matched FROM covered GROUP BY ALL)
SELECT d.doc_id, CASE WHEN len({_TOKENS('text')}) > 0 THEN round(100.0 * coalesce(matched, 0) / len({_TOKENS('text')}), 2) ELSE 0.0 END::DOUBLE AS percentage_of_license_text FROM documents d LEFT JOIN n USING (doc_id)
""")
def license_text_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of license text."""
    return lic.license_share(_documents(spark, sf_dir), _matches(spark, sf_dir), "doc_id")


@query(f"""
WITH {MATCHES}, counted AS (SELECT doc_id, line, count(*) AS n FROM tokens WHERE tok IN ({_LEGALESE}) GROUP BY ALL HAVING count(*) >= 2)
SELECT doc_id, line, n FROM counted c WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = c.doc_id AND c.line BETWEEN k.start_line AND k.end_line)
""")
def license_unknown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with license words that no match explains."""
    return lic.unknown_runs(_documents(spark, sf_dir), _matches(spark, sf_dir), "doc_id", least=2).select("doc_id", *_long("line", "n"))


_LICENSES = ", ".join(f"({_quote(k)}, {_quote(n)}, {_quote(s) if s else 'NULL'}, {_quote(c)})" for k, (n, s, c) in rl.DEFAULT_LICENSES.items())


@query(f"WITH {MATCHES} SELECT key, name, spdx, category FROM (VALUES {_LICENSES}) AS l(key, name, spdx, category) WHERE key IN (SELECT expression FROM kept)")
def license_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that some match names."""
    found = lic.license_references(_matches(spark, sf_dir), rl.default_licenses(spark))
    return found.select("key", "name", F.col("spdx_license_key").alias("spdx"), "category")


_SPDX = ("MIT", "Apache-2.0 OR MIT", "GPL-3.0-only AND (MIT OR MPL-2.0)", "LicenseRef-own", "MIT OR")


@query(f"""
SELECT p_partkey, 2::BIGINT AS line, [{_list(_SPDX)}][1 + p_size % 5] AS spdx_text, CASE p_size % 5 WHEN 0 THEN 'mit' WHEN 1 THEN 'apache-2.0,mit' WHEN 2 THEN 'gpl-3.0,mit,mpl-2.0' WHEN 3 THEN 'licenseref-own' END AS keys, p_size % 5 <> 4 AS ok FROM part
""")
def spdx_identifier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier lines, parsed once each."""
    stated = F.get(F.array(*[F.lit(s) for s in _SPDX]), (F.col("p_size") % 5).cast("int"))
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("#!/bin/sh\n# SPDX-License-Identifier: "), stated, F.lit("\n")).alias("text"))
    found = lic.spdx_matches(files, rl.spdx_names(rl.default_licenses(spark)), "p_partkey")
    return found.select("p_partkey", *_long("line"), "spdx_text", F.array_join("keys", ",").alias("keys"), "ok")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'mit' WHEN 1 THEN 'apache-2.0 OR mit' WHEN 2 THEN 'gpl-2.0 WITH classpath-exception-2.0 AND gpl-2.0' ELSE 'mit AND bsd-new' END AS combined,
  CASE o_orderkey % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0 OR MIT' WHEN 2 THEN 'LicenseRef-scancode-gpl-2.0 WITH LicenseRef-scancode-classpath-exception-2.0 AND LicenseRef-scancode-gpl-2.0' ELSE 'MIT AND BSD-3-Clause' END AS spdx FROM orders
""")
def license_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions combined, simplified and mapped."""
    k = F.col("o_orderkey") % 4
    parts = (
        F.when(k == 0, F.array(F.lit("mit"), F.lit("MIT OR mit"))).when(k == 1, F.array(F.lit("apache-2.0 OR mit")))
        .when(k == 2, F.array(F.lit("gpl-2.0 WITH classpath-exception-2.0"), F.lit("gpl-2.0"))).otherwise(F.array(F.lit("mit"), F.lit("bsd-new"), F.lit("mit OR gpl-3.0")))
    )
    combined = table(spark, sf_dir, "orders").select("o_orderkey", ex.combine_column(parts).alias("combined"))
    return combined.select("o_orderkey", "combined", ex.spdx_column(F.col("combined"), rl.spdx_names(rl.default_licenses(spark))).alias("spdx"))


@query()
def license_sequence_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned runs of lines and their near-duplicate rules (L9). The alignment is a procedure; tests hold it against
    another one."""
    lines = tx.explode_lines(_documents(spark, sf_dir), "text", "doc_id").select(F.concat_ws(":", "doc_id", "line").alias("line_id"), F.col("text_line").alias("text"))
    rules = rl.default_rules(spark)
    found = lic.sequence_matches(lines, rules, "line_id", candidates=lic.near_duplicate_rules(lines, rules, "line_id"))
    return found.select("line_id", "rid", "start_token", "end_token", "matched_length", "match_coverage")
