import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tracewell.llm import quality, queries

from .cases import empty, frame, nasty_rows


def test_votes_against_plain_loops():
    rng = np.random.default_rng(2)
    rows = (rng.random((300, quality.TERMS)) * (rng.random((300, quality.TERMS)) < 0.1)).astype(np.float32)
    labels = (rng.random(200) < 0.4).astype(float)
    space = quality.build_space(rows[:200], labels)
    rows[250] = 0
    got = quality.vote(space, rows)
    for k in (0, 10, 199, 200, 249, 250, 299):
        if not rows[k].any():
            assert got[k] == labels.mean()
            continue
        v = (np.sqrt(rows[k]) * space.weights) @ space.axes
        similar = [float(np.dot(v / np.linalg.norm(v), u)) for u in space.vectors]
        top = sorted(range(200), key=lambda i: -similar[i])[: quality.NEIGHBOURS]
        weight = [np.exp(quality.SHARPNESS * (similar[i] - similar[top[0]])) for i in top]
        assert got[k] == pytest.approx(sum(w * labels[i] for w, i in zip(weight, top)) / sum(weight), abs=1e-3)


def test_axes_are_singular_directions():
    rng = np.random.default_rng(3)
    rows = rng.random((80, quality.TERMS)).astype(np.float32)
    space = quality.build_space(rows, np.ones(80))
    values = np.linalg.svd(np.sqrt(rows) * space.weights, compute_uv=False)
    kept = np.linalg.norm((np.sqrt(rows) * space.weights) @ space.axes, axis=0)
    assert np.allclose(kept, values[: quality.DIMENSIONS], rtol=1e-3)


def test_held_out_accuracy(spark, sf_mid):
    """Beyond the share of the more frequent label."""
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf_mid}/labels.parquet").select("doc_id", "quality").collect()}
    rows = [r for r in queries.op5_quality(spark, sf_mid).where("held_out").collect() if r["doc_id"] in truth]
    right = np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows])
    often = max(np.mean([truth[r["doc_id"]] for r in rows]), 1 - np.mean([truth[r["doc_id"]] for r in rows]))
    assert len(rows) > 50 and right > max(0.85, often)


@pytest.mark.parametrize("clash", [False, True])
def test_nasty_rows(spark, clash):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (7, 0), (99, 1), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality.score_quality(frame(spark, nasty_rows(), clash), labels).collect()
    assert len(got) == len(nasty_rows()) and all(0 <= r["score"] <= 1 for r in got)


def test_nothing_labelled(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(frame(spark, nasty_rows()), none).collect()} == {0.5}
    assert quality.score_quality(empty(spark), none).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    learn = F.col("id") % 3 != 1
    turned = labels.withColumn("quality", F.when(F.col("doc_id") % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r[0], r[1]) for r in quality.score_quality(docs, x, learn=learn).select("doc_id", "score").collect()) for x in (labels, turned))
    assert a == b


def test_words_of_equal_shapes_are_told_apart(spark):
    """Good and bad texts of unrepeated lower-case words of like lengths: only which words they are differs."""
    rng = random.Random(4)
    good, bad = (["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 9))) for _ in range(60)] for _ in range(2))
    rows = [(k, " ".join(rng.sample(good if k % 2 else bad, 25))) for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows if k < 200], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(frame(spark, rows), labels).collect()}
    assert sum((got[k] >= 0.5) == bool(k % 2) for k in range(200, 300)) >= 97


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    rows = [(1, "good text"), (2, "bad text")] * 50 + [(1, "another")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    terms, marks = quality.labelled_terms(frame(spark, rows), labels, "doc_id", "text", "doc_id", "quality", F.lit(True))
    assert len(terms) == 2 and sorted(marks) == [0, 1]


def plain_terms(text):
    words = [w for w in re.split(rb"[ \t-\r]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text)) if w]
    raw = [w for w in re.split(rb"[ \t-\r]+", text) if w]
    n, out = len(words), np.zeros(quality.TERMS)
    if not n:
        return out
    for w in raw:
        shape = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in w)
        short = re.sub(rb"(.)\1+", rb"\1+", shape, flags=re.DOTALL)
        out[zlib.crc32(short, len(shape).bit_length()) % quality.SHAPES] += 1 / n
    h = [zlib.crc32(w) for w in words]
    for x in h:
        out[quality.SHAPES + x % quality.WORDS] += 1 / n
    for a, b in zip(h, h[1:]):
        out[quality.SHAPES + quality.WORDS + ((b << 32) | a) % quality.PAIRS] += 1 / (n - 1)
    if n > 1:
        out[-3] = sum(a == b for a, b in zip(h, h[1:])) / (n - 1)
        out[-2] = 1 - len(Counter(zip(h, h[1:]))) / (n - 1)
    if n > 2:
        out[-1] = 1 - len(Counter(zip(h, h[1:], h[2:]))) / (n - 2)
    return out


def test_query_over_the_whole_table_against_plain_python(spark, sf_small):
    """Terms word by word, the sample row by row, and votes by a loop over all labelled vectors."""
    texts = {r[0]: (r[1] or "").encode() for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf_small}/labels.parquet").select("doc_id", "quality").collect() if r[1] is not None}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    learned = sorted((i for i in labels if i in texts and not held(i)), key=str)
    space = quality.build_space(np.array([plain_terms(texts[i]) for i in learned], np.float32), np.array([labels[i] for i in learned]))
    got = queries.op5_quality(spark, sf_small).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts) and len(learned) > quality.NEIGHBOURS
    for r in got:
        v = (np.sqrt(plain_terms(texts[r["doc_id"]])) * space.weights) @ space.axes
        similar = (space.vectors @ (v / np.linalg.norm(v))).tolist()
        top = sorted(similar, reverse=True)[quality.NEIGHBOURS - 1]
        near = [k for k, s in enumerate(similar) if s >= top - 1e-9]
        weight = [np.exp(quality.SHARPNESS * similar[k]) for k in near]
        want = sum(w * labels[learned[k]] for w, k in zip(weight, near)) / sum(weight)
        assert r["held_out"] == held(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.5) and r["score"] == pytest.approx(want, abs=2e-2)
