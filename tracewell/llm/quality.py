"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words and pairs of words (hashed), the shapes of its tokens (letters a or A, digits 9, other
characters themselves) and how far tokens, pairs and triples repeat. Square roots of term shares, weighted by rarity among
the labelled texts, are projected on the leading directions of a singular value decomposition of the labelled texts. Those vectors, of at most
LABELLED rows chosen by a hash of their id, are broadcast; every text is compared with all of them in blocks of exact
cosine products, and the labels of its nearest ones vote with weights that grow with similarity.

A null or empty text has no terms; it and any text when nothing is labelled score the share of label 1 among the
labelled texts (0.5 if there are none). Labels that are null count as none; of repeated labels of an id the largest
counts. Rows with equal texts get equal scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_texts
from .words import SPACE_TABLE

#: Labelled texts that the neighbours are chosen from, at most.
LABELLED = 4096
SHAPES, WORDS, PAIRS, REPEATS = 509, 1021, 509, 3
TERMS = SHAPES + WORDS + PAIRS + REPEATS
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 30.0
#: Documents whose products with all labelled vectors are in memory at once.
BLOCK = 256
_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


class _Buckets(dict):
    """Term number of a token's shape, of which each run of a sign counts as one with a mark, and of its length."""

    def __missing__(self, shape: bytes) -> int:
        value = crc32(_RUN.sub(rb"\1+", shape), len(shape).bit_length()) % SHAPES
        if len(self) < 100_000:
            self[shape] = value
        return value


def terms(text: bytes, buckets: dict) -> np.ndarray:
    """Shares of the tokens' shapes, of the hashed words and of their pairs; then of tokens like the one before, and of
    pairs and triples met before."""
    out = np.zeros(TERMS, np.float32)
    words = text.translate(SPACE_TABLE).split()
    n = len(words)
    if not n:
        return out
    shapes = np.fromiter(map(buckets.__getitem__, text.translate(_SHAPE).split()), np.int64, n)
    hashed = np.fromiter(map(crc32, words), np.uint64, n)
    out[:SHAPES] = np.bincount(shapes, minlength=SHAPES) / n
    out[SHAPES : SHAPES + WORDS] = np.bincount((hashed % np.uint64(WORDS)).astype(np.int64), minlength=WORDS) / n
    if n > 1:
        pairs = (hashed[1:] << np.uint64(32)) | hashed[:-1]
        at = SHAPES + WORDS
        out[at : at + PAIRS] = np.bincount((pairs % np.uint64(PAIRS)).astype(np.int64), minlength=PAIRS) / (n - 1)
        out[-3] = (hashed[1:] == hashed[:-1]).mean()
        out[-2] = 1 - len(set(pairs.tolist())) / (n - 1)
    if n > 2:
        triples = pairs[1:] * np.uint64(0x9E3779B97F4A7C15) + hashed[:-2]
        out[-1] = 1 - len(set(triples.tolist())) / (n - 2)
    return out


@dataclass
class Space:
    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5


def build_space(rows: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Space:
    """rows: terms of the labelled texts."""
    if not len(rows):
        return Space(np.zeros(TERMS), np.zeros((TERMS, dimensions)), np.zeros((0, dimensions)), np.zeros(0))
    present = (rows > 0).sum(axis=0)
    weights = np.log((1 + len(rows)) / (1 + present)) + 0.3
    matrix = np.sqrt(rows) * weights
    values, axes = np.linalg.eigh(matrix.T.astype(np.float64) @ matrix)
    axes = axes[:, np.argsort(-values)[:dimensions]]
    return Space(weights, axes, unit(matrix @ axes), labels.astype(np.float64))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def vote(space: Space, rows: np.ndarray) -> np.ndarray:
    out = np.full(len(rows), space.prior)
    if not len(space.labels):
        return out
    k = min(NEIGHBOURS, len(space.labels))
    for lo in range(0, len(rows), BLOCK):
        part = rows[lo : lo + BLOCK]
        near = unit((np.sqrt(part) * space.weights) @ space.axes) @ space.vectors.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        similar = np.take_along_axis(near, top, axis=1).astype(np.float64)
        weight = np.exp(SHARPNESS * (similar - similar.max(axis=1, keepdims=True)))
        score = (weight * space.labels[top]).sum(axis=1) / weight.sum(axis=1)
        some = part.any(axis=1)
        out[lo : lo + BLOCK][some] = score[some]
    return np.clip(out, 0.0, 1.0)


def labelled_terms(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, learn: Column) -> tuple[np.ndarray, np.ndarray]:
    """Terms and labels of the sample, ordered by id. The sample is chosen before texts are read."""
    usable = labels.select(F.col(f"`{label_id}`").alias("id"), F.col(f"`{label_col}`").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    chosen = (
        usable.groupBy("id").agg(F.max("label").alias("label")).where(learn).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(LABELLED)
    )
    named = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    held = named.join(F.broadcast(chosen), F.col("_id") == F.col("id"))

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        buckets = _Buckets()
        rows = [terms(t, buckets).tobytes() for t in as_bytes(batch.column(1))]
        yield {"key": batch.column(0).cast(pa.string()), "label": batch.column(2), "terms": rows}

    each = map_texts(held, "_id", "_text", "key string, label double, terms binary", work, {"label": F.col("label").cast("double")})
    # One row for an id, so that repeats of an id in ``docs`` don't make the sample larger.
    least = each.groupBy("key").agg(F.min(F.struct("label", "terms")).alias("x")).select("key", "x.label", "x.terms").collect()
    found = sorted((r[0], r[1], bytes(r[2])) for r in least)
    rows = np.array([np.frombuffer(r[2], np.float32) for r in found]).reshape(-1, TERMS)
    return rows, np.array([r[1] for r in found])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "quality",
    learn: Column | None = None,
) -> DataFrame:
    """Per row: id and ``score`` from 0 to 1. learn: which ids (column ``id``) may be learned from."""
    space = build_space(*labelled_terms(docs, labels, id_col, text_col, label_id, label_col, F.lit(True) if learn is None else learn))
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        buckets = _Buckets()
        rows = np.array([terms(t, buckets) for t in as_bytes(batch.column(1))], np.float32).reshape(-1, TERMS)
        yield {"key": batch.column(0), "score": vote(shared.value, rows)}

    return map_texts(docs, id_col, text_col, "key {key}, score double", work).withColumnRenamed("key", id_col)
