"""Line dedup: overlapping three-line windows, in DataFrame operations only.

Lines are cut at LF and compared with white space at both ends removed; blank lines belong to no window. A window is
``window`` consecutive lines that aren't blank. Documents are ordered by id (nulls last), then by their text's hash,
windows within a document by place. Every occurrence of a window's text but the first is removed: the lines from its
first to its last, blank ones between them included. Overlapping occurrences are merged, so a line goes if any later
occurrence covers it. A text of fewer than ``window`` lines stays as it is, a null one stays null.

Windows are known by 128 bits of hash. Repeated rows (same id and text) are one document: each row gets the same
result. First places are aggregated before the shuffle, so a window that is everywhere costs one row a task; the join
back is a sort-merge join, of which adaptive execution splits hot windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _windows(text: Column, window: int) -> Column:
    """Array of (two hashes, first and last line) over the lines that aren't blank."""
    trimmed = F.transform(F.split(text, "\n"), lambda line, i: F.struct(F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")).alias("s"), i.alias("i")))
    return F.filter(trimmed, lambda x: x["s"] != "")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Per row: id (or the columns ``keep``), ``text`` without the lines removed, ``n_lines`` (of the text given; null
    for a null text) and ``n_removed``."""
    text = F.col(f"`{text_col}`").cast("string")
    kept = [id_col] if keep is None else keep
    keyed = docs.select(
        F.col(f"`{id_col}`").alias("_key"), text.alias("_text"), F.xxhash64(text).alias("_hash"),
        *[F.col(f"`{k}`").alias(f"_keep{n}") for n, k in enumerate(kept)],
    )
    lines = keyed.select("_key", "_hash", _windows(F.col("_text"), window).alias("lines")).where(F.size("lines") >= window)
    count = F.size("lines") - (window - 1)
    shifted = lines.select("_key", "_hash", *[F.slice("lines", F.lit(k + 1), count).alias(f"l{k}") for k in range(window)])
    zipped = shifted.select("_key", "_hash", F.arrays_zip(*[f"l{k}" for k in range(window)]).alias("zipped"))
    texts = lambda w: [w[f"l{k}"]["s"] for k in range(window)]
    hashed = F.transform(
        "zipped",
        lambda w: F.struct(
            F.xxhash64(*texts(w)).alias("h1"), F.xxhash64(F.lit(1), *texts(w)).alias("h2"),
            w["l0"]["i"].alias("from"), w[f"l{window - 1}"]["i"].alias("to"),
        ),
    )
    found = zipped.select("_key", "_hash", F.inline(hashed))
    place = F.struct(F.col("_key").isNull().alias("last"), F.col("_key").alias("key"), F.col("_hash").alias("hash"), F.col("from").alias("at"))
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    later = found.join(firsts.hint("merge"), ["h1", "h2"]).where(place > F.col("first"))
    covered = later.groupBy("_key", "_hash").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("covered"))
    joined = keyed.join(
        covered.select(F.col("_key").alias("_key2"), F.col("_hash").alias("_hash2"), "covered"),
        F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("_hash") == F.col("_hash2")), "left",
    )
    split = joined.withColumn("_lines", F.split("_text", "\n")).withColumn("_n", F.size("_lines"))
    # The lines before each covered run that begins after all earlier ones end, then what follows the last.
    gaps = F.concat(
        F.transform("covered", lambda c, i: F.struct(F.when(i == 0, 0).otherwise(F.get(F.col("covered"), i - 1)["to"] + 1).alias("a"), c["from"].alias("b"))),
        F.array(F.struct((F.element_at("covered", -1)["to"] + 1).alias("a"), F.col("_n").alias("b"))),
    )
    left = split.withColumn("_gaps", F.when(F.col("covered").isNotNull(), F.filter(gaps, lambda g: g["b"] > g["a"])))
    rest = F.flatten(F.transform("_gaps", lambda g: F.slice("_lines", g["a"] + 1, g["b"] - g["a"])))
    removed = F.col("_n") - F.aggregate("_gaps", F.lit(0), lambda n, g: n + g["b"] - g["a"])
    return left.select(
        *[F.col(f"_keep{n}").alias(k) for n, k in enumerate(kept) if k != text_col],
        F.when(F.col("_gaps").isNull(), F.col("_text")).otherwise(F.array_join(rest, "\n")).alias(text_col),
        F.when(F.col("_text").isNotNull(), F.col("_n")).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS i, trim(translate(l[i], chr(9) || chr(13) || chr(11) || chr(12), '    ')) AS s
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) d, unnest(range(1, len(l) + 1)) AS r(i)
), windows AS (
  SELECT doc_id, i AS a, lead(i, 2) OVER w AS b, s AS s0, lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2
  FROM lines WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT doc_id, a, b FROM (
    SELECT *, row_number() OVER (PARTITION BY s0, s1, s2 ORDER BY doc_id, a) AS nth FROM windows WHERE b IS NOT NULL
  ) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, i FROM later, unnest(range(a, b + 1)) AS r(i)
), raw AS (
  SELECT doc_id, i - 1 AS i, l[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) d, unnest(range(1, len(l) + 1)) AS r(i)
), rest AS (
  SELECT r.doc_id, string_agg(CASE WHEN g.i IS NULL THEN r.line END, chr(10) ORDER BY r.i) AS text, count(*) AS n_lines, count(g.i) AS n_removed
  FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.i = g.i GROUP BY r.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, r.n_lines, coalesce(r.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN rest r ON d.doc_id = r.doc_id
"""
