"""License detection: tokens, exact and near matches with rules, detections, references.

Matches are rows (key, rid, license_expression, kind, matcher, start_line, end_line, start_token, end_token,
matched_length, rule_length, match_coverage, score, relevance). Texts are tokenised in the JVM; rules are a dimension
whose size is checked before it is broadcast (``bounded``), and joined by shuffle if it is larger.
"""

from __future__ import annotations

import hashlib
from difflib import SequenceMatcher
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..functions import text as tx
from .rules import LEGALESE, SMALL_TOKENS, TINY_TOKENS

TOKEN = r"[a-z0-9]+\+?[a-z0-9]*"
#: Markup that isn't part of a license text.
STOPWORDS = frozenset("p br div span li ul ol td tr pre quot amp lt gt nbsp href".split())
HASH, SPDX, EXACT, SEQUENCE = "1-hash", "1-spdx-id", "2-aho", "3-seq"
NEAR_RESEMBLANCE, NEAR_MOST, RUN_MOST = 0.8, 10, 50
#: Rows of a dimension up to which it is broadcast.
BROADCAST_ROWS = 500_000
#: Rules up to which texts are tested for their words before they are cut into tokens.
FEW_RULES = 64
#: Lines between two matches beyond which they belong to different detections.
LINES_APART = 4
MATCH = (
    "rid", "license_expression", "kind", "matcher", "start_line", "end_line", "start_token", "end_token", "matched_length",
    "rule_length", "match_coverage", "score", "relevance",
)


#: Rule tokens, at most, that are looked for within a text's array of tokens.
FEW_TOKENS = 10_000


def bounded(dimension: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if the table has at most ``rows`` rows; as it is, for a shuffle join, if it has more."""
    return F.broadcast(dimension) if len(dimension.select(F.lit(1)).take(rows + 1)) <= rows else dimension


def tokens(text: Column, stopwords: frozenset[str] = STOPWORDS) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*sorted(stopwords))) if stopwords else found


def line_tokens(text: Column) -> Column:
    """Array of struct(line, token) over a whole text."""
    numbered = F.transform(tx.lines(text), lambda s, i: F.transform(tokens(s), lambda t: F.struct((i + 1).alias("line"), t.alias("token"))))
    return F.flatten(numbered)


def token_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(text)))


def token_counts(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, token, n: the multiset of a text's tokens."""
    return df.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def high_value(counts: DataFrame, legalese: frozenset[str] = LEGALESE) -> DataFrame:
    return counts.where(F.col("token").isin(*sorted(legalese)))


def rule_tokens(rules: DataFrame, legalese: frozenset[str] = LEGALESE) -> DataFrame:
    """rid, pos, token, is_legalese."""
    found = rules.select("rid", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    return found.withColumn("is_legalese", F.col("token").isin(*sorted(legalese)))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules with tokens, length, size classes and token hash; of rules with equal tokens that with the best relevance."""
    made = rules.withColumn("tokens", tokens(F.col("text"))).withColumn("rule_length", F.size("tokens")).where("rule_length > 0")
    made = made.withColumn("token_hash", token_hash(F.col("tokens")))
    made = made.withColumn("is_small", F.col("rule_length") < SMALL_TOKENS).withColumn("is_tiny", F.col("rule_length") < TINY_TOKENS)
    best = Window.partitionBy("token_hash").orderBy(F.desc("relevance"), "identifier")
    return made.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def token_hash(of: Column) -> Column:
    return F.sha1(F.array_join(of, " ").cast("binary"))


def _match(df: DataFrame, key: str, matcher: str) -> DataFrame:
    """Rows of the match table from joined rows with start, length (of the match) and lines."""
    coverage = F.round(100.0 * F.col("length") / F.col("rule_length"), 2)
    return df.select(
        key, "rid", "license_expression", "kind", F.lit(matcher).alias("matcher"), "start_line", "end_line",
        F.col("start").alias("start_token"), (F.col("start") + F.col("length")).alias("end_token"), F.col("length").alias("matched_length"),
        "rule_length", coverage.alias("match_coverage"), F.round(coverage * F.col("relevance") / 100, 2).alias("score"), "relevance",
    )


def hash_matches(df: DataFrame, rules: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Texts whose whole token run is a rule's."""
    ready = bounded(prepared_rules(rules).select("rid", "license_expression", "kind", "relevance", "rule_length", "token_hash"))
    runs = df.select(key, line_tokens(F.col(text)).alias("t")).where(F.size("t") > 0)
    found = runs.withColumn("token_hash", token_hash(F.col("t.token"))).join(ready, "token_hash")
    lines = found.select("*", F.lit(0).alias("start"), F.size("t").alias("length"), F.col("t.line")[0].alias("start_line"), F.element_at("t.line", -1).alias("end_line"))
    return _match(lines, key, HASH)


def exact_matches(df: DataFrame, rules: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Every place, overlapping ones too, where a rule's tokens stand one after another.

    Texts that can't hold a rule go first, if the rules are few: one has to hold all words of one. Then a place is looked
    at only if its token begins a rule of the length; the windows that are left are joined with the rules by their text."""
    ready = prepared_rules(rules).where("NOT is_false_positive").select("rid", "license_expression", "kind", "relevance", "rule_length", F.array_join("tokens", " ").alias("rule_text"), F.col("tokens")[0].alias("head"))
    firsts: dict[int, list[str]] = {}
    for n, head in ready.select("rule_length", "head").distinct().collect():
        firsts.setdefault(n, []).append(head)
    runs = _may_hold(df, text, ready).select(key, line_tokens(F.col(text)).alias("t")).select(key, F.col("t.token").alias("tokens"), F.col("t.line").alias("lines"))
    windows = F.array().cast("array<struct<start:int,length:int,rule_text:string>>")
    for n, heads in sorted(firsts.items()):
        windows = F.concat(windows, _windows(F.col("tokens"), n, sorted(heads)))
    opened = runs.select(key, "lines", F.inline(windows))
    placed = opened.withColumn("start_line", F.get("lines", F.col("start"))).withColumn("end_line", F.get("lines", F.col("start") + F.col("length") - 1)).drop("lines")
    return _match(placed.join(bounded(ready.drop("head")), "rule_text"), key, EXACT)


def _may_hold(df: DataFrame, text: str, ready: DataFrame) -> DataFrame:
    """Texts with all words of some rule, longest words first, where there are at most FEW_RULES."""
    rules = [r[0].split(" ") for r in ready.select("rule_text").limit(FEW_RULES + 1).collect()]
    if len(rules) > FEW_RULES:
        return df
    low, hit = F.lower(F.col(text)), F.lit(False)
    for words in rules:
        own = F.lit(True)
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            own = own & low.contains(w)
        hit = hit | own
    return df.where(hit)


def _windows(found: Column, n: int, heads: list[str]) -> Column:
    places = F.filter(F.transform(found, lambda t, i: F.when(t.isin(*heads), i)), lambda i: i.isNotNull() & (i + n <= F.size(found)))
    return F.transform(places, lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), F.array_join(F.slice(found, i + 1, F.lit(n)), " ").alias("rule_text")))


def automaton_matches(df: DataFrame, rules: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """As ``exact_matches``, by one automaton over all rules: for rule sets with many lengths and first words. The automaton
    is broadcast, so a set of more than BROADCAST_ROWS rules goes to ``exact_matches``."""
    import ahocorasick

    if len(rules.select(F.lit(1)).take(BROADCAST_ROWS + 1)) > BROADCAST_ROWS:
        return exact_matches(df, rules, key, text)
    ready = prepared_rules(rules).where("NOT is_false_positive").select("rid", "license_expression", "kind", "relevance", "rule_length", F.array_join("tokens", " ").alias("rule_text"))
    automaton = ahocorasick.Automaton()
    for rid, length, rule_text in ready.select("rid", "rule_length", "rule_text").toLocalIterator():
        automaton.add_word(f" {rule_text} ", (rid, length))
    if len(automaton):
        automaton.make_automaton()
    shared = df.sparkSession.sparkContext.broadcast(automaton)
    kind = dict(df.dtypes)[key]
    runs = df.select(F.col(key).alias("k"), line_tokens(F.col(text)).alias("t")).select("k", F.concat(F.lit(" "), F.array_join("t.token", " "), F.lit(" ")).alias("s"), F.col("t.line").alias("lines"))

    def run(batches):
        for batch in batches:
            rows, places = [], []
            for n, (s, lines) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if not len(shared.value) or not lines:
                    continue
                starts = np.frombuffer(s.encode("utf-32-le"), np.uint32) == 32
                before = np.cumsum(starts)
                for end, (rid, length) in shared.value.iter(s):
                    start = int(before[end]) - 1 - length
                    rows.append(n)
                    places.append((rid, start, length, lines[start], lines[start + length - 1]))
            columns = list(zip(*places, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int32()) for c in columns)], ["k", "rid", "start", "length", "start_line", "end_line"])

    found = runs.mapInArrow(run, f"k {kind}, rid int, start int, length int, start_line int, end_line int").withColumnRenamed("k", key)
    return _match(found.join(bounded(ready.drop("rule_text")), "rid"), key, EXACT)


SPDX_LINE = r"(?i)SPDX-License-Identifier:?[ \t]*([\w.+() \t-]+)"


def spdx_matches(df: DataFrame, names: dict[str, str | None], key: str = "path", text: str = "text") -> DataFrame:
    """One row for each identifier line: key, line, expression (by license keys; unknown ids stay), spdx, keys, error."""
    back = {s.lower(): k for k, s in names.items() if s}
    found = tx.explode_lines(df, text, key).withColumn("found", F.trim(F.regexp_extract("text_line", SPDX_LINE, 1))).where("found <> ''")
    parsed = found.withColumn("p", ex.parse_column(F.col("found")))
    pairs = [F.lit(x) for kv in back.items() for x in kv]
    own = F.transform("p.keys", lambda k: F.coalesce(F.try_element_at(F.create_map(*pairs), k), k) if pairs else k)
    return parsed.select(key, "line", F.col("found").alias("spdx_text"), F.array_sort(F.array_distinct(own)).alias("keys"), F.col("p.ok").alias("ok"), F.col("p.error").alias("error"))


def candidate_rules(df: DataFrame, rules: DataFrame, key: str = "path", text: str = "text", most: int = RUN_MOST, least_resemblance: float = 0.0, legalese: frozenset[str] = LEGALESE) -> DataFrame:
    """The ``most`` rules of each text by multiset resemblance among those that share a legalese token:
    key, rid, shared (tokens, repeats counted), containment (of the rule), resemblance, rank.

    Texts join rules by token; counts are summed per text and rule before they are ranked."""
    df = df.where(reduce(or_, [F.lower(F.col(text)).contains(w) for w in sorted(legalese)], F.lit(False)))
    of_rule = rule_tokens(prepared_rules(rules), legalese).groupBy("rid", "token").agg(F.count(F.lit(1)).alias("rule_n"), F.max("is_legalese").alias("is_legalese"))
    lengths = of_rule.groupBy("rid").agg(F.sum("rule_n").alias("rule_length"))
    # Tokens are taken from a text once; in the array those that no rule has go, where the rules have few, so that little is
    # exploded and shuffled.
    listed = [r[0] for r in of_rule.select("token").distinct().take(FEW_TOKENS + 1)]
    found = df.select(key, tokens(F.col(text)).alias("_t"))
    own = F.filter("_t", lambda t: t.isin(*listed)) if len(listed) <= FEW_TOKENS else F.col("_t")
    counts = found.select(key, F.size("_t").alias("length"), own.alias("_t")).where(F.size("_t") > 0).select(key, "length", F.explode("_t").alias("token"))
    wanted = bounded(of_rule.join(bounded(lengths), "rid"))
    mine = counts.join(bounded(of_rule.select("token").distinct()), "token", "left_semi").groupBy(key, "length", "token").agg(F.count(F.lit(1)).alias("n"))
    pairs = mine.join(wanted, "token").groupBy(key, "rid", "length", "rule_length").agg(
        F.sum(F.least("n", "rule_n")).alias("shared"), F.max("is_legalese").alias("legalese")
    )
    scored = pairs.where("legalese").withColumn("containment", F.round(F.col("shared") / F.col("rule_length"), 6))
    scored = scored.withColumn("resemblance", F.round(F.col("shared") / (F.col("length") + F.col("rule_length") - F.col("shared")), 6))
    order = Window.partitionBy(key).orderBy(F.desc("resemblance"), F.desc("containment"), "rid")
    ranked = scored.where(F.col("resemblance") >= least_resemblance).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= most).select(key, "rid", "shared", "containment", "resemblance", "rank")


def near_duplicate_rules(df: DataFrame, rules: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    return candidate_rules(df, rules, key, text, NEAR_MOST, NEAR_RESEMBLANCE)


def sequence_matches(df: DataFrame, rules: DataFrame, key: str = "path", text: str = "text", candidates: DataFrame | None = None, legalese: frozenset[str] = LEGALESE) -> DataFrame:
    """Aligned runs of tokens of a text and each of its candidate rules. Blocks without a legalese token give nothing."""
    pairs = candidate_rules(df, rules, key, text, legalese=legalese) if candidates is None else candidates
    ready = bounded(prepared_rules(rules).select("rid", "license_expression", "kind", "relevance", "rule_length", F.col("tokens").alias("rule_tokens")))
    runs = df.select(F.col(key).alias("_k"), line_tokens(F.col(text)).alias("t"))
    joined = pairs.select(key, "rid").join(runs, F.col(key) == F.col("_k")).join(ready, "rid")
    kinds = F.array(*[F.lit(w) for w in sorted(legalese)])

    @F.arrow_udf("array<struct<start:int,length:int,rule_start:int>>")
    def align(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            blocks = SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
            out.append([{"start": m.a, "length": m.size, "rule_start": m.b} for m in blocks if m.size])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("rule_start", pa.int32())])))

    blocks = joined.withColumn("b", align(F.col("t.token"), F.col("rule_tokens")))
    opened = blocks.select("*", F.inline("b")).where(F.arrays_overlap(F.slice("t.token", F.col("start") + 1, F.col("length")), kinds))
    lines = opened.withColumn("start_line", F.get("t.line", F.col("start"))).withColumn("end_line", F.get("t.line", F.col("start") + F.col("length") - 1))
    return _match(lines, key, SEQUENCE)


def without_contained(matches: DataFrame, key: str = "path") -> DataFrame:
    """Drops a match whose tokens all lie in a longer match of the same text; of equal ones the first rule stays.

    One window per text: the farthest end of the matches that begin before."""
    order = Window.partitionBy(key).orderBy("start_token", F.desc("end_token"), "rid").rowsBetween(Window.unboundedPreceding, -1)
    return matches.withColumn("_far", F.max("end_token").over(order)).where("_far IS NULL OR end_token > _far").drop("_far")


def detections(matches: DataFrame, key: str = "path", lines_apart: int = LINES_APART) -> DataFrame:
    """Matches near one another as one detection: key, detection, start_line, end_line, license_expression, coverage,
    matches. Islands over lines, then one row each."""
    order = Window.partitionBy(key).orderBy("start_line", "start_token", "rid")
    far = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start_line") - far > lines_apart, 1).otherwise(0)
    islands = matches.withColumn("_new", new).withColumn("detection", F.sum("_new").over(order))
    columns = [c for c in MATCH if c in matches.columns]
    grouped = islands.groupBy(key, "detection").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), coverage(F.col("match_coverage"), F.col("matched_length")).alias("coverage"),
        F.array_sort(F.collect_list(F.struct("start_token", "rid", F.struct(*columns).alias("m")))).alias("_m"),
    )
    return grouped.select(
        key, "detection", "start_line", "end_line", ex.combine_column(F.col("_m.m.license_expression")).alias("license_expression"), "coverage",
        F.col("_m.m").alias("matches"),
    )


def coverage(covered: Column, length: Column) -> Column:
    """Aggregate: coverage weighted by length, at most 100; plain mean if all lengths are zero."""
    weighted = F.sum(covered * length) / F.nullif(F.sum(length), F.lit(0))
    return F.round(F.least(F.lit(100.0), F.coalesce(weighted, F.avg(covered), F.lit(0.0))), 4)


def _quoted(s: str) -> str:
    escaped = s.replace("\\", "\\\\")
    return '"' + escaped.replace('"', '\\"') + '"' if "'" in s and '"' not in s else "'" + escaped.replace("'", "\\'") + "'"


def _tuple(parts: list[str]) -> str:
    return "(" + ", ".join(parts) + ("," if len(parts) == 1 else "") + ")"


def detection_identifier(expression: str | None, content: list[tuple[str, float, list[str]]]) -> str:
    """Stable name of a detection from its rules, scores and matched tokens."""
    name, gap = "", False
    for c in expression or "":
        if c.isalnum():
            name, gap = name + c, False
        elif not gap:
            name, gap = name + "_", True
    shown = _tuple([f"({_quoted(rule)}, {float(np.float32(score))!s}, {_tuple([_quoted(t) for t in toks]) if toks else '()'})" for rule, score, toks in content])
    h = hashlib.sha1(shown.encode()).hexdigest()[:32]
    return f"{name.strip('_')}-{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def identifier_column(expression: Column, content: Column) -> Column:
    """content: array of struct(rule identifier, score, tokens)."""

    @F.arrow_udf("string")
    def run(e: pa.Array, c: pa.Array) -> pa.Array:
        rows = zip(e.to_pylist(), c.to_pylist(), strict=True)
        return pa.array([detection_identifier(x, [tuple(m.values()) for m in y or []]) for x, y in rows], pa.string())

    return run(expression, content)


def unique_detections(found: DataFrame, identifier: str = "identifier", key: str = "path") -> DataFrame:
    """identifier, license_expression, detection_count, and the first place of each."""
    place = F.struct(F.col(key).alias("path"), "start_line", "end_line")
    return found.groupBy(identifier).agg(F.min("license_expression").alias("license_expression"), F.count(F.lit(1)).alias("detection_count"), F.min(place).alias("first_region"))


def split_clues(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches of rules that detect, and of clue rules."""
    clue = F.col("kind") == "clue"
    return matches.where(~clue), matches.where(clue)


def without_ignorables(findings: DataFrame, matches: DataFrame, rules: DataFrame, value: str, ignorable: str, key: str = "path") -> DataFrame:
    """Findings (key, value, start_line, end_line) that no matched rule explains: anti-join on key and value, where the
    lines overlap."""
    known = bounded(rules.select("rid", F.explode(ignorable).alias("_value")))
    explained = matches.select(F.col(key).alias("_key"), "rid", F.col("start_line").alias("_from"), F.col("end_line").alias("_to")).join(known, "rid")
    same = (F.col(key) == F.col("_key")) & (F.col(value) == F.col("_value")) & (F.col("start_line") <= F.col("_to")) & (F.col("_from") <= F.col("end_line"))
    return findings.join(explained.drop("rid"), same, "left_anti")


def license_share(df: DataFrame, matches: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, percentage_of_license_text: matched tokens, each once, of all. Runs are joined before they are summed."""
    order = Window.partitionBy(key).orderBy("start_token", "end_token")
    far = F.coalesce(F.max("end_token").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = matches.withColumn("_own", F.greatest(F.lit(0), F.col("end_token") - F.greatest(far, F.col("start_token"))))
    summed = own.groupBy(key).agg(F.sum("_own").alias("matched"))
    total = df.select(key, F.size(tokens(F.col(text))).alias("total"))
    share = F.when(F.col("total") > 0, F.round(100.0 * F.coalesce("matched", F.lit(0)) / F.col("total"), 2)).otherwise(0.0)
    return total.join(summed, key, "left").select(key, share.alias("percentage_of_license_text"))


def license_references(matches: DataFrame, licenses: DataFrame) -> DataFrame:
    """Licenses that some match names."""
    named = matches.select(F.explode(ex.keys_column(F.col("license_expression"))).alias("key")).distinct()
    return licenses.join(named, "key", "left_semi")


def rule_references(matches: DataFrame, rules: DataFrame) -> DataFrame:
    return rules.join(matches.select("rid").distinct(), "rid", "left_semi")


def unknown_runs(df: DataFrame, matches: DataFrame, key: str = "path", text: str = "text", least: int = 5, legalese: frozenset[str] = LEGALESE) -> DataFrame:
    """Lines outside all matches that hold at least ``least`` legalese tokens: key, line, n."""
    lines = tx.explode_lines(df, text, key).select(key, "line", F.size(F.filter(tokens(F.col("text_line")), lambda t: t.isin(*sorted(legalese)))).alias("n")).where(F.col("n") >= least)
    known = matches.select(F.col(key).alias("_k"), F.explode(F.sequence("start_line", "end_line")).alias("_line")).distinct()
    return lines.join(known, (F.col(key) == F.col("_k")) & (F.col("line") == F.col("_line")), "left_anti")


def scan_licenses(df: DataFrame, rules: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Tiers with early exit: a text that is a rule as a whole is done; the others get exact matches."""
    whole = hash_matches(df, rules, key, text)
    rest = df.join(whole.select(key).distinct(), key, "left_anti")
    return whole.unionByName(without_contained(exact_matches(rest, rules, key, text), key))
