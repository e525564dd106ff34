"""Language ID: a byte convolutional network in numpy, over fixed-length windows of whole texts.

Bytes (A-Z lower-cased) are embedded; filters of several widths slide over a window of WINDOW bytes, each filter's
largest value in the window passes a rectifier, and a softmax layer gives a language. A text is cut into consecutive
windows, the last of which may be shorter; its logits are the windows' means weighted by length. The network is trained
on a sample of labelled texts: at most about ROWS_PER_LANGUAGE texts of each language, SAMPLE_ROWS in all, chosen by a
hash of their id, with WINDOWS_PER_TEXT windows spread over each. Every language has one text at least. Everything is seeded, so the same table gives the same network.

A null text and one without a letter are ``und`` with score 0, as is every text if no language was learned. Rows with
equal texts get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
ROWS_PER_LANGUAGE = 400
WINDOWS_PER_TEXT = 4
#: Texts of the sample in all, about: with very many languages each has fewer texts, but one at least.
SAMPLE_ROWS = 80_000
EPOCHS = 8
BATCH = 128
#: Windows whose convolutions are in memory at once.
BLOCK = 512
UNKNOWN = "und"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_TAIL = max(WIDTHS) - 1


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width, the parts whose sum is the convolution: offset, and rows by byte pair or, for one byte left
        over, by byte."""
        out = []
        for width, w in zip(WIDTHS, self.filters, strict=True):
            one = [(self.embedding @ w[k * EMBEDDING : (k + 1) * EMBEDDING]).astype(np.float32) for k in range(width)]
            parts = [(k, (one[k][:, None, :] + one[k + 1][None, :, :]).reshape(1 << 16, FILTERS)) for k in range(0, width - 1, 2)]
            out.append(parts + ([(width - 1, one[-1])] if width % 2 else []))
        return out


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def window_starts(length: int) -> range:
    return range(0, length, WINDOW)


def pooled(tables: list[list[tuple[int, np.ndarray]]], buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Largest value of each filter in each window. The windows lie one after another in ``buffer``, with _TAIL zero
    bytes at least after the last of each text; bytes between windows are left out."""
    out = np.empty((len(starts), FILTERS * len(WIDTHS)), np.float32)
    for lo in range(0, len(starts), BLOCK):
        hi = min(lo + BLOCK, len(starts))
        a, b = int(starts[lo]), int(ends[hi - 1])
        part = buffer[a : b + _TAIL + 1]
        pair = (part[:-1].astype(np.int32) << 8) | part[1:]
        edges = np.stack([starts[lo:hi] - a, ends[lo:hi] - a], axis=1).ravel()
        edges = edges[:-1]  # the last window ends with the part
        # A window's end and the next one's start may be the same place: that segment is skipped below anyway.
        for k, parts in enumerate(tables):
            total = None
            for offset, rows in parts:
                picked = rows[(pair if len(rows) > 256 else part)[offset : offset + b - a]]
                total = picked if total is None else np.add(total, picked, out=total)
            out[lo:hi, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(total, edges, axis=0)[::2]
    return out


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts with zero bytes between, and of each window the start, end and text."""
    buffer = np.frombuffer((b"\0" * _TAIL).join([*(t.translate(LOWER) for t in texts), b"\0"]), np.uint8)
    at, starts, ends, owner = 0, [], [], []
    for k, t in enumerate(texts):
        for s in window_starts(len(t)):
            starts.append(at + s)
            ends.append(at + min(s + WINDOW, len(t)))
            owner.append(k)
        at += len(t) + _TAIL
    return buffer, np.array(starts, np.int64), np.array(ends, np.int64), np.array(owner, np.int64)


def predict(net: Network, tables: list, texts: list[bytes]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [k for k, t in enumerate(texts) if has_letter(t)]
    if not net.languages or not known:
        return names, scores
    buffer, starts, ends, owner = lay_out([texts[k] for k in known])
    hidden = np.maximum(pooled(tables, buffer, starts, ends) + net.bias, 0)
    logits = (hidden @ net.weights + net.out_bias).astype(np.float64)
    size = (ends - starts).astype(np.float64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    mean = np.add.reduceat(logits * size[:, None], first, axis=0) / np.add.reduceat(size, first)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for k, row in zip(known, p, strict=True):
        names[k], scores[k] = net.languages[int(row.argmax())], float(row.max())
    return names, scores


def train(windows: list[tuple[bytes, str]], seed: int = 7) -> Network:
    """Adam on cross-entropy; gradients pass only the place where a filter is largest."""
    languages = sorted({lang for _, lang in windows})
    rng = np.random.default_rng(seed)
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)),
        [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS)),
        rng.normal(0, 0.2, (FILTERS * len(WIDTHS), max(1, len(languages)))),
        np.zeros(max(1, len(languages))),
    )
    if not languages:
        return net
    data = np.zeros((len(windows), WINDOW), np.uint8)
    length = np.zeros(len(windows), np.int64)
    for k, (text, _) in enumerate(windows):
        t = text[:WINDOW].translate(LOWER)
        data[k, : len(t)] = np.frombuffer(t, np.uint8)
        length[k] = len(t)
    number = {lang: k for k, lang in enumerate(languages)}
    target = np.array([number[lang] for _, lang in windows])
    share = np.bincount(target, minlength=len(languages))
    weight = (len(target) / len(languages) / share)[target]
    values = [net.embedding, *net.filters, net.bias, net.weights, net.out_bias]
    moment, square, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x, n = data[rows], len(rows)
            padded = np.concatenate([x, np.zeros((n, _TAIL), np.uint8)], axis=1)
            embedded = net.embedding[padded]
            outside = np.arange(WINDOW)[None, :] >= length[rows][:, None]
            best, patches = [], []
            for width, w in zip(WIDTHS, net.filters, strict=True):
                conv = sum(embedded[:, k : k + WINDOW] @ w[k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(width))
                conv[outside] = -np.inf
                where = conv.argmax(axis=1)
                best.append(np.take_along_axis(conv, where[:, None, :], axis=1)[:, 0])
                patches.append(padded[np.arange(n)[:, None, None], where[:, :, None] + np.arange(width)])
            summed = np.concatenate(best, axis=1) + net.bias
            hidden = np.maximum(summed, 0)
            logits = hidden @ net.weights + net.out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), target[rows]] -= 1
            p *= (weight[rows] / n)[:, None]
            back = (p @ net.weights.T) * (summed > 0)
            grads = [np.zeros_like(net.embedding), *[np.zeros_like(w) for w in net.filters], back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            for i, (width, w) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(width):
                    seen = patches[i][:, :, k]
                    grads[1 + i][k * EMBEDDING : (k + 1) * EMBEDDING] += np.einsum("nfe,nf->ef", net.embedding[seen], g)
                    np.add.at(grads[0], seen.ravel(), (g[:, :, None] * w[k * EMBEDDING : (k + 1) * EMBEDDING].T[None]).reshape(-1, EMBEDDING))
            step += 1
            for v, g, m, s in zip(values, grads, moment, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def sample_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column) -> list[tuple[bytes, str]]:
    """Windows of the training sample, in an order that doesn't depend on partitions."""
    usable = docs.where(learn & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    lang = F.col(f"`{lang_col}`").cast("string")
    counts = usable.groupBy(lang.alias("_lang")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.xxhash64(F.col(f"`{id_col}`").cast("string"))).alias("_least")).collect()
    if not counts:
        return []
    most = max(1, min(ROWS_PER_LANGUAGE, SAMPLE_ROWS // len(counts)))
    rates = docs.sparkSession.createDataFrame([(r["_lang"], most / r["_n"], r["_least"]) for r in counts], "_lang string, _rate double, _least long")
    hashed = F.xxhash64(F.col("_id").cast("string"))
    # A row for each language, as the network has a column for each: the side that is broadcast is no larger than that.
    chosen = (
        usable.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), lang.alias("_of"))
        .join(F.broadcast(rates), F.col("_of") == F.col("_lang"))
        .where((F.pmod(hashed, F.lit(1 << 20)) / F.lit(float(1 << 20)) < F.col("_rate")) | (hashed == F.col("_least")))
    )

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        windows = []
        for text in as_bytes(batch.column(1)):
            every = [text[s : s + WINDOW] for s in window_starts(len(text)) if has_letter(text[s : s + WINDOW])]
            step = max(1, len(every) // WINDOWS_PER_TEXT)
            windows.append(every[::step][:WINDOWS_PER_TEXT])
        yield {"key": batch.column(0), "windows": windows, "lang": batch.column(2)}

    each = map_texts(chosen, "_id", "_text", "key {key}, windows array<binary>, lang string", work, {"lang": F.col("_of")})
    # One row for an id, so that repeats of an id don't make the sample larger.
    rows = each.groupBy("key").agg(F.min(F.struct("lang", "windows")).alias("x")).select("x.*").collect()
    return sorted((bytes(w), r["lang"]) for r in rows for w in r["windows"])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Per row: id (or the columns ``keep``), ``lang_pred`` and ``score``, the network's probability of it.

    learn: the rows that may be learned from, all by default.
    """
    net = train(sample_windows(docs, id_col, text_col, lang_col, F.lit(True) if learn is None else learn))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = [id_col] if keep is None else keep
    state: dict = {}

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        if not state:
            state["tables"] = shared.value.tables()
        names, scores = predict(shared.value, state["tables"], as_bytes(batch.column(1)))
        yield {**{f"k{n}": batch.column(2 + n) for n in range(len(kept))}, "lang": names, "score": scores}

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"_keep{n} {kinds[k]}" for n, k in enumerate(kept)), "lang_pred string, score double"])
    out = map_texts(docs, id_col, text_col, schema, work, {f"_keep{n}": F.col(f"`{k}`") for n, k in enumerate(kept)})
    return out.select(*[F.col(f"_keep{n}").alias(k) for n, k in enumerate(kept)], "lang_pred", "score")
