"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. The sets are
the five-word shingles of a window (all of its words if it has fewer than five). Shingles are ordered by rarity in the
documents, counted over all of them. Containment has to be complete, so the necessary prefix of a window is its rarest
shingle: a document that holds the window holds that shingle, at the window's offset. Documents are joined with windows
on it; a candidate must fit between the document's ends (length and position), and is then compared word by word.

Nulls and texts without words give no window and no hit. Items with equal texts each count. Repeated rows of documents
are judged each on its own. Items are numbered by their id as given; rows with the same item id count as one item.

The index of the items is broadcast in blocks of at most BLOCK_BYTES of item text, so a broadcast's size is bounded
whatever the size of the benchmark. Blocks are read, indexed and let go one after another; each is joined with all
documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, map_texts
from .words import WORD_TABLE, ranges, shingle_codes, split_words, words_of

WINDOW = 13
SHINGLE = 5
#: Text of the items in one broadcast; an item longer than this makes a block of its own.
BLOCK_BYTES = 4 << 20


@dataclass
class Windows:
    """Windows of one length: their words' numbers, shingles, and the items (by position) that have them."""

    length: int
    words: np.ndarray
    items_at: np.ndarray
    items: np.ndarray
    shingle: int
    codes: np.ndarray
    #: After ordering: sorted codes of prefix shingles, then for each the windows and offsets.
    prefix: np.ndarray | None = None
    at: np.ndarray | None = None
    window: np.ndarray | None = None
    offset: np.ndarray | None = None


def build_windows(items: list[list[bytes]], window: int) -> tuple[dict[bytes, int], list[Windows]]:
    vocabulary: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], list[int]]] = {}
    for k, words in enumerate(items):
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        size = min(window, len(ids))
        for at in range(len(ids) - size + 1 if size else 0):
            owners = found.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), [])
            if not owners or owners[-1] != k:
                owners.append(k)
    out = []
    for length, by_words in sorted(found.items()):
        matrix = np.array(list(by_words), np.int64)
        shingle = min(SHINGLE, length)
        counts = np.array([len(x) for x in by_words.values()])
        codes = np.stack([shingle_codes(row, shingle) for row in matrix])
        out.append(Windows(length, matrix, np.concatenate([[0], np.cumsum(counts)]), np.concatenate([np.array(x) for x in by_words.values()]), shingle, codes))
    return vocabulary, out


def order_windows(groups: list[Windows], rarity: dict[tuple[int, int], int]) -> None:
    """Chooses each window's rarest shingle, the leftmost of those; rarity: by shingle length and code."""
    for g in groups:
        known, where = np.unique(g.codes, return_inverse=True)
        counts = np.array([rarity.get((g.shingle, int(c)), 0) for c in known])[where.reshape(g.codes.shape)]
        offset = counts.argmin(axis=1)
        code = g.codes[np.arange(len(g.codes)), offset]
        order = np.argsort(code, kind="stable")
        g.prefix, at = np.unique(code[order], return_index=True)
        g.at = np.concatenate([at, [len(order)]])
        g.window, g.offset = order, offset[order]


def find_windows(ids: np.ndarray, bounds: np.ndarray, groups: list[Windows]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and owner (item, with a row for each) of every window's occurrence. bounds: where documents begin
    and end in ids."""
    starts, lengths, owners = [], [], []
    codes = {s: shingle_codes(ids, s) for s in {g.shingle for g in groups}}
    for g in groups:
        c = codes[g.shingle]
        here = np.flatnonzero(c >= 0)
        where = np.searchsorted(g.prefix, c[here])
        where[where == len(g.prefix)] = 0
        hit = g.prefix[where] == c[here]
        here, where = here[hit], where[hit]
        n = g.at[where + 1] - g.at[where]
        entry = ranges(g.at[where], n)
        begin = np.repeat(here, n) - g.offset[entry]
        document = np.searchsorted(bounds, np.repeat(here, n), side="right") - 1
        fits = (begin >= bounds[document]) & (begin + g.length <= bounds[document + 1])
        begin, window = begin[fits], g.window[entry[fits]]
        for at in range(0, len(begin), 1 << 18):
            b, w = begin[at : at + (1 << 18)], window[at : at + (1 << 18)]
            same = (ids[b[:, None] + np.arange(g.length)] == g.words[w]).all(axis=1)
            b, w = b[same], w[same]
            k = g.items_at[w + 1] - g.items_at[w]
            starts.append(np.repeat(b, k))
            lengths.append(np.full(int(k.sum()), g.length))
            owners.append(g.items[ranges(g.items_at[w], k)])
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
    return join(starts), join(lengths), join(owners)


def _words_of_batch(texts: pa.Array, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, 0 for those that no item has, and where texts begin and end in them."""
    words, sizes = split_words(texts, WORD_TABLE)
    found = pc.index_in(words, pa.array(vocabulary, pa.binary()))
    ids = pc.add(pc.fill_null(found, -1), 1).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _rarity(docs: DataFrame, id_col: str, text_col: str, index) -> dict[tuple[int, int], int]:
    """How often each shingle of the windows is found in the documents; as many rows as the block has shingles."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        vocabulary, groups = index.value
        ids, bounds = _words_of_batch(batch.column(1), vocabulary)
        edge = np.zeros(len(ids) + 1, np.int64)
        edge[bounds] = 1
        document = np.cumsum(edge)
        size, code, count = [], [], []
        for s in sorted({g.shingle for g in groups}):
            known = np.unique(np.concatenate([g.codes.ravel() for g in groups if g.shingle == s]))
            c = shingle_codes(ids, s)
            whole = (c >= 0) & (document[: len(c)] == document[s - 1 : s - 1 + len(c)])
            c = c[whole]
            at = np.searchsorted(known, c)
            at[at == len(known)] = 0
            n = np.bincount(at[known[at] == c], minlength=len(known))
            full = np.flatnonzero(n)
            size += [s] * len(full)
            code += known[full].tolist()
            count += n[full].tolist()
        yield {"size": size, "code": code, "n": count}

    counted = map_texts(docs, id_col, text_col, "size int, code long, n long", work)
    return {(r[0], r[1]): r[2] for r in counted.groupBy("size", "code").agg(F.sum("n").alias("n")).collect()}


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks. Ids with no text or no words never match and still belong to a block."""
    rows = benchmark.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t"))
    block, size = [], 0
    for i, t in rows.toLocalIterator():
        n = len(t.encode()) if t else 0
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += n
    if block:
        yield block


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _matched(batch: pa.RecordBatch, index) -> Iterator[dict]:
    """Adds a block's occurrences to the columns spans and items (the last two) of a slice."""
    vocabulary, groups, item_ids = index.value
    ids, bounds = _words_of_batch(batch.column(1), vocabulary)
    starts, lengths, owners = find_windows(ids, bounds, groups)
    spans, items = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
    if len(starts):
        document = np.searchsorted(bounds, starts, side="right") - 1
        order = np.argsort(document, kind="stable")
        document, starts, lengths, owners = document[order], starts[order], lengths[order], owners[order]
        rows, at = np.unique(document, return_index=True)
        for row, lo, hi in zip(rows.tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
            begin = starts[lo:hi] - bounds[row]
            runs = set(zip(begin.tolist(), (begin + lengths[lo:hi]).tolist(), strict=True))
            spans[row] = [{"from": a, "to": b} for a, b in _merged([*((x["from"], x["to"]) for x in spans[row]), *runs])]
            items[row] = items[row] + [item_ids[k] for k in np.unique(owners[lo:hi]).tolist()]
    yield {"words": np.diff(bounds).tolist(), "spans": spans, "items": items}


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per row of documents: its id, ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``spans`` (hit
    runs of words: first, and the one after the last) and ``items`` (ids of items with an occurrence, in any order).

    keep: columns of ``docs`` to return instead of the id alone.
    """
    spark = docs.sparkSession
    item_kind = dict(benchmark.dtypes)[item_id]
    kept = [id_col] if keep is None else keep
    frame = docs.select(
        F.col(f"`{id_col}`").alias("_key"), F.col(f"`{text_col}`").cast("string").alias("_text"),
        *[F.col(f"`{k}`").alias(f"_keep{n}") for n, k in enumerate(kept)],
        F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans"), F.array().cast(f"array<{item_kind}>").alias("items"),
    )
    held, passes = frame.columns, 0
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        frame = _with_block(frame.select(*held), block, window, lambda index: _rarity(docs, id_col, text_col, index), spark)
        passes += 1
    if not passes:
        frame = _with_block(frame, [], window, lambda index: {}, spark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return frame.select(*[F.col(f"_keep{n}").alias(k) for n, k in enumerate(kept)], "n_words", hit.alias("n_hit"), "spans", F.array_distinct("items").alias("items"))


def _with_block(frame: DataFrame, block: list[tuple], window: int, rarity: Callable, spark: SparkSession) -> DataFrame:
    """The rows with a block's occurrences added. Nothing of the block stays in the driver but its broadcast's file."""
    by_id: dict = {}
    for i, t in block:
        by_id.setdefault(i, []).append(words_of((t or "").encode()))
    item_ids = list(by_id)
    owner = np.array([k for k, i in enumerate(item_ids) for _ in by_id[i]])
    numbers, groups = build_windows([words for i in item_ids for words in by_id[i]], window)
    vocabulary = list(numbers)
    for g in groups:
        g.items = owner[g.items]
    order_windows(groups, rarity(spark.sparkContext.broadcast((vocabulary, groups))) if groups else {})
    index = spark.sparkContext.broadcast((vocabulary, groups, item_ids))
    return map_slices(frame, "_text", frame.schema.simpleString()[7:-1] + ",n_words:bigint", _adder(index))


def _adder(index):
    def work(batch: pa.RecordBatch) -> Iterator[list]:
        for out in _matched(batch, index):
            yield [*batch.columns[:-2], out["spans"], out["items"], out["words"]]

    return work


def oracle_sql(window: int = WINDOW) -> str:
    """DuckDB SQL of the registered query."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    return f"""
WITH doc AS (
  SELECT doc_id, {words} AS w FROM documents
), item AS (
  SELECT item_id, w, least(len(w), {window}) AS size FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0
), wanted AS (
  SELECT DISTINCT item_id, size, array_to_string(w[k : k + size - 1], ' ') AS s FROM item, unnest(range(1, len(w) - size + 2)) AS r(k)
), sizes AS (
  SELECT DISTINCT size FROM wanted
), held AS (
  SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS s
  FROM doc, sizes, unnest(range(1, greatest(len(w) - size + 2, 1))) AS r(k)
), hits AS (
  SELECT doc_id, k, held.size, item_id FROM held JOIN wanted ON held.size = wanted.size AND held.s = wanted.s
), counted AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT doc_id, k, size FROM hits)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
"""
