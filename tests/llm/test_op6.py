import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tracewell.llm import hmm, queries

from .cases import empty, frame, nasty_rows

SPACES = b" \t\n\r\x0b\x0c"


def tokens(text):
    data = bytes(c + 32 if 65 <= c <= 90 else 32 if c in SPACES else c for c in (text or "").encode())
    return [w for w in data.split(b" ") if w] + [None]


def base(rows, learned):
    counts = Counter(w for i, t in rows if learned(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {(i, t): (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}


@pytest.mark.parametrize("clash", [False, True])
def test_base_model_by_hand(spark, clash):
    rows = nasty_rows()
    want = base(rows, lambda i: (i or 0) % 2 == 0)
    got = hmm.score_texts(frame(spark, rows, clash), learn=F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0).collect()
    a = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    b = sorted((i is None, i or 0, *want[(i, t)][:3], round(want[(i, t)][3], 6)) for i, t in rows)
    assert a == b and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_words_beyond_the_broadcast_ones(spark, monkeypatch):
    rows = [r for r in nasty_rows() if r[0] is not None]
    whole = sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 5)) for r in hmm.score_texts(frame(spark, rows)).collect())
    monkeypatch.setattr(hmm.read_vocabulary, "__defaults__", (12,))
    few = sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in hmm.score_texts(frame(spark, rows)).select("doc_id", "n_known", "base_score").collect())
    assert few == [x[:3] for x in whole]


def test_query_against_base(spark, sf_small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    want = base(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    texts = dict(rows)
    held, score, plain = [], 0, 0
    for r in queries.op6_hmm(spark, sf_small).collect():
        w = want[(r["doc_id"], texts[r["doc_id"]])]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and r["base_score"] == pytest.approx(w[3], abs=1e-6)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        if r["held_out"]:
            held.append(r["doc_id"])
            score, plain = score + r["score"], plain + r["base_score"]
    assert held and score > plain  # latent states tell more than single words


def some_model(states=3, seed=4):
    rng = np.random.default_rng(seed)
    emits = rng.random((hmm.CLASSES, states))
    moves = rng.random((states, states))
    start = rng.random(states)
    return hmm.Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def by_paths(model, seq):
    total, counts = 0.0, Counter()
    for path in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[path[0]] * model.emits[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= model.moves[path[t - 1], path[t]] * model.emits[seq[t], path[t]]
        total += p
        counts["start", path[0]] += p
        for t in range(len(seq)):
            counts["emit", seq[t], path[t]] += p
            if t:
                counts["move", path[t - 1], path[t]] += p
    return total, {k: v / total for k, v in counts.items()}


def test_forward_and_expected_counts_over_all_paths():
    model, rng = some_model(), np.random.default_rng(5)
    seqs = [rng.integers(0, 6, n) for n in (1, 5, 3, 6, 2, 5)]
    flat, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    got = hmm.log_likelihoods(model, flat, lengths)
    assert np.allclose(got, [math.log10(by_paths(model, s)[0]) for s in seqs])
    starts, moves, emits = hmm.expected_counts(model, flat, lengths)
    for s in range(3):
        assert starts[s] == pytest.approx(sum(by_paths(model, q)[1].get(("start", s), 0) for q in seqs))
        for u in range(3):
            assert moves[s, u] == pytest.approx(sum(by_paths(model, q)[1].get(("move", s, u), 0) for q in seqs))
        for c in range(6):
            assert emits[c, s] == pytest.approx(sum(by_paths(model, q)[1].get(("emit", c, s), 0) for q in seqs))


def test_long_sequences_do_not_underflow(monkeypatch):
    model, rng = some_model(), np.random.default_rng(6)
    seqs = [rng.integers(0, 50, n) for n in (5000, 1, 30, 30)]
    flat, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    whole = hmm.log_likelihoods(model, flat, lengths)
    monkeypatch.setattr(hmm, "TOKENS", 40)
    assert np.isfinite(whole).all() and np.allclose(whole, hmm.log_likelihoods(model, flat, lengths))


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(7)
    seqs = [np.array([k % 3 + (3 if rng.random() < 0.2 else 0) for k in range(40)]) for _ in range(20)]
    flat, lengths = np.concatenate(seqs), np.array([40] * 20)
    model, last = some_model(), -math.inf
    for _ in range(6):
        now = hmm.log_likelihoods(model, flat, lengths).sum()
        assert now > last - 1e-6
        last, model = now, hmm.maximise(*hmm.expected_counts(model, flat, lengths))


def test_probabilities_of_a_token_sum_to_one(spark):
    """Over the classes, and over the words of a class with one unseen word."""
    rows = [(k, f"w{k} common common thing{k % 7}") for k in range(40)]
    counts = hmm.count_tokens(frame(spark, rows), "doc_id", "text", F.lit(True))
    vocabulary = hmm.read_vocabulary(counts)
    tokens_, words = hmm.class_totals(counts, vocabulary.words[:3])
    away = [(w, c) for w, c in zip(vocabulary.words[3:], vocabulary.counts[3:].tolist())]
    for k in range(hmm.SHAPES):
        own = [c for w, c in away if hmm.shape_of(w) == k]
        assert sum(own) == tokens_[k] and len(own) == words[k]
        if own:
            assert sum((c + 1) / (tokens_[k] + words[k] + 1) for c in own) + 1 / (tokens_[k] + words[k] + 1) == pytest.approx(1)


def test_empty_and_unlearned(spark):
    assert hmm.score_texts(empty(spark)).count() == 0
    rows = hmm.score_texts(frame(spark, nasty_rows()), learn=F.lit(False)).collect()
    assert len(rows) == len(nasty_rows()) and {r["train_tokens"] for r in rows} == {0} and {r["n_known"] for r in rows} == {0}
