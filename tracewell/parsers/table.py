"""Manifest rows of a table of files.

The JVM drops all files whose path no reader takes, before their content goes anywhere, and nulls content beyond the size
limit; what is left goes to Python in Arrow batches. No shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache, reduce
from operator import or_
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .base import MOST_BYTES, PACKAGE_SCHEMA, READERS, Reader, rows_of


def _name_alone(pattern: str) -> bool:
    """Whether an expression looks at nothing before a path's last slash."""
    return "/" not in pattern.replace("(?:^|/)", "").replace("[^/]", "")


@lru_cache(1)
def _compiled() -> tuple[list[tuple[int, re.Pattern]], list[tuple[int, re.Pattern]]]:
    """Places in the table and patterns: those that look at a file's name alone, and those at its path."""
    named, others = [], []
    for n, r in enumerate(READERS):
        (named if _name_alone(r.paths) else others).append((n, re.compile(r.paths)))
    return named, others


def _last_part(pattern: str) -> re.Pattern | None:
    """What an expression over paths asks of a file's name; None where that isn't plain to tell."""
    flags, bare = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    bare = bare.replace("[^/]", "\0").replace("(?:^|/)", "/")
    last = bare.rpartition("/")[2]
    outside = re.sub(r"\([^()]*\)", "", bare)
    if "/" not in bare or not last.endswith("$") or "|" in outside or "(" in outside or last.count("(") != last.count(")"):
        return None
    return re.compile(flags + "^" + last.replace("\0", "[^/]"))


@lru_cache(100_000)
def _by_name(name: str) -> tuple[tuple[int, ...], tuple[tuple[int, re.Pattern], ...]]:
    """Readers that take a file of this name wherever it is, and those whose expression its path has to pass."""
    named, others = _compiled()
    return tuple(n for n, p in named if p.search(name)), tuple((n, p) for n, p in others if (last := _last_part(p.pattern)) is None or last.search(name))


def matching_readers(path: str) -> list[Reader]:
    """Readers that take a path, in the table's order."""
    named, others = _by_name(path.rpartition("/")[2])
    return [READERS[n] for n in sorted([*named, *(n for n, p in others if p.search(path))])]


_ROWS = 1000
_LITERAL = re.compile(r"(?:[\w -]|\\[^\w])+")


def _unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def needed_literals(parsed: Iterable) -> frozenset[str]:
    """Texts of which what a parsed expression matches holds one at least; none where that isn't plain to tell."""
    found, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        found.append(frozenset([run] if run else []))
        run = ""
        if op is _parser.SUBPATTERN:
            found.append(needed_literals(value[3]))
        elif op is _parser.BRANCH:
            each = [needed_literals(b) for b in value[1]]
            found.append(frozenset().union(*each) if all(each) else frozenset())
    return max(found, key=lambda f: min(map(len, f), default=0))


def path_filter(path: Column, readers: list[Reader]) -> Column:
    """Whether some reader may take a path. Most are known by a file's name or ending, which are looked up in a set; an
    expression is tried only where the name fits its last part, or where the path holds a text that it needs. Python tests
    the whole expression again."""
    names, endings, tails, tailed, others = set(), set(), set(), [], []
    for p in dict.fromkeys(r.paths for r in readers):
        whole = re.fullmatch(r"\(\?:\^\|/\)(?:\(\?:(.+)\)|(.+))\$", p)
        ending = re.fullmatch(r"(?:\(\?i\))?\\\.(?:\(\?:([\w|]+)\)|(\w+))\$", p)
        last = p.replace("[^/]", "\0").rpartition("/")[2].removesuffix("$")
        if whole and "(?i)" not in p and all(_LITERAL.fullmatch(a) for a in (whole[1] or whole[2]).split("|")):
            names |= {_unescaped(a) for a in (whole[1] or whole[2]).split("|")}
        elif ending:
            endings |= set((ending[1] or ending[2]).lower().split("|"))
        elif "/" in p.replace("[^/]", "") and "|" not in p.replace("(?:^|/)", "") and "(?i)" not in p and _LITERAL.fullmatch(last):
            tails.add(_unescaped(last))
            tailed.append(p)
        else:
            others.append(p)
    any_of = lambda patterns, path: path.rlike("|".join(f"(?:{p})" for p in patterns))
    guarded = []
    for p in others:  # looking for a text is much quicker than trying an expression at each place
        parsed = _parser.parse(p)
        low = bool(parsed.state.flags & re.IGNORECASE)
        guarded.append((p, low, sorted(t.lower() if low else t for t in needed_literals(parsed))))

    def test(path: Column, name: Column, lowered: Column) -> Column:
        hit = F.lit(False)
        if names:
            hit = hit | name.isin(*sorted(names))
        if endings:
            hit = hit | F.substring_index(F.lower(name), ".", -1).isin(*sorted(endings))
        if tails:
            hit = hit | (name.isin(*sorted(tails)) & any_of(tailed, path))
        for p, low, held in guarded:
            fits = (name if _name_alone(p) else path).rlike(p)
            hit = hit | (reduce(or_, ((lowered if low else path).contains(t) for t in held)) & fits if held else fits)
        return hit

    # each of the three is made once a row, as a lambda's variable
    with_name = lambda p: F.exists(F.array(F.substring_index(p, "/", -1)), lambda n: F.exists(F.array(F.lower(p)), lambda w: test(p, n, w)))
    return F.exists(F.array(path), with_name)


def readers_table(spark: SparkSession) -> DataFrame:
    """datasource_id, type, paths, form, primary_language, about: one row for each reader."""
    rows = [(r.datasource, r.type, r.paths, r.form, r.language, r.about) for r in READERS]
    return spark.createDataFrame(rows, "datasource_id string, type string, paths string, form string, primary_language string, about string")


def package_data(files: DataFrame, path: str = "path", content: str = "content", datasources: list[str] | None = None) -> DataFrame:
    """path and the columns of PACKAGE_SCHEMA, for each manifest among files (path, content as binary or string).

    A reader whose document can't be read gives a row with its type and datasource alone; null content counts as that."""
    wanted = [r for r in READERS if datasources is None or r.datasource in datasources]
    if not wanted:
        return files.sparkSession.createDataFrame([], f"path string, {PACKAGE_SCHEMA}")
    raw = F.col(content).cast("binary")
    own = files.where(path_filter(F.col(path), wanted)).select(F.col(path).alias("path"), F.when(F.octet_length(raw) <= MOST_BYTES, raw).alias("content"))
    schema = f"path string, {PACKAGE_SCHEMA}"
    target = to_arrow_schema(_parse_datatype_string(schema))
    chosen = frozenset(r.datasource for r in wanted)

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for reader in matching_readers(p):
                    if reader.datasource not in chosen:
                        continue
                    made = rows_of(reader, p, c)
                    rows += [{"path": p, **r} for r in made]
                    if made:
                        break
                if len(rows) >= _ROWS:  # many dicts at once are slow to keep and to convert
                    yield pa.RecordBatch.from_pylist(rows, schema=target)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    return own.mapInArrow(run, schema)
