import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tracewell.llm import language, queries

from .cases import empty, frame, nasty_rows


def test_held_out_accuracy(spark, sf_mid):
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf_mid}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op9_language(spark, sf_mid).where("held_out").collect() if truth[r["doc_id"]]]
    right = np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows])
    assert len(rows) > 100 and right > 0.95


def direct(net, text):
    """Logits of a text by convolutions written out."""
    data, total, size = text.translate(language.LOWER), 0.0, 0
    for s in range(0, len(data), language.WINDOW):
        e = min(s + language.WINDOW, len(data))
        wide = data[s : e + language._TAIL].ljust(e - s + language._TAIL, b"\0")
        hidden = []
        for width, w in zip(language.WIDTHS, net.filters):
            conv = [np.concatenate([net.embedding[wide[k + j]] for j in range(width)]) @ w for k in range(e - s)]
            hidden.append(np.max(conv, axis=0))
        hidden = np.maximum(np.concatenate(hidden) + net.bias, 0)
        total, size = total + (hidden @ net.weights + net.out_bias) * (e - s), size + e - s
    return total / size


def test_tables_equal_convolutions():
    net = language.train([(b"the quick brown fox jumps", "en"), ("der schnelle braune fuchs".encode(), "de")] * 4)
    texts = [b"a", b"The fox", b"x" * 255, b"y" * 256 + b"z", bytes(range(33, 127)) * 20, "größe ☃".encode()]
    names, scores = language.predict(net, net.tables(), texts)
    for text, name, score in zip(texts, names, scores):
        logits = direct(net, text)
        p = np.exp(logits - logits.max())
        assert name == net.languages[int(p.argmax())] and score == pytest.approx(p.max() / p.sum(), abs=1e-4)


def test_gradients_against_differences():
    """One small step of training lowers the loss on what it was trained on."""
    windows = [(b"aaaa bbbb", "x"), (b"cccc dddd", "y")] * 40
    net = language.train(windows)
    names, scores = language.predict(net, net.tables(), [b"aaaa bbbb", b"cccc dddd"])
    assert names == ["x", "y"] and min(scores) > 0.9


@pytest.mark.parametrize("clash", [False, True])
def test_nasty_rows(spark, clash):
    docs = frame(spark, nasty_rows(), clash).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") < 9, "bb"))
    got = language.identify(docs).collect()
    assert len(got) == len(nasty_rows()) and all(0 <= r["score"] <= 1 for r in got)
    unknown = sorted(repr(r["doc_id"]) for r in got if r["lang_pred"] == "und")
    assert unknown == sorted(repr(i) for i, t in nasty_rows() if not any(c.isalpha() for c in t or ""))


def test_nothing_learned(spark):
    docs = frame(spark, nasty_rows()).withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs).collect()} == {("und", 0.0)}
    assert language.identify(empty(spark).withColumn("lang", F.lit("x"))).count() == 0


def test_same_table_same_network(spark, sf_small):
    a, b = (sorted(map(tuple, queries.op9_language(spark, sf_small).collect())) for _ in range(2))
    assert a == b


def test_every_language_is_learned(spark, monkeypatch):
    """Also those of one text among hundreds of languages, and with a sample of few texts; repeats of an id count once."""
    rows = [(k, f"text {k} of a tongue", f"l{k % 230:03d}") for k in range(500)] + [(500 + k, "much of one", "big") for k in range(300)] + [(7, "text 7 of a tongue", "l007")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = language.sample_windows(docs, "doc_id", "text", "lang", F.lit(True))
    assert {lang for _, lang in whole} == {lang for _, _, lang in rows} and sum(w == b"text 7 of a tongue" for w, _ in whole) == 1
    monkeypatch.setattr(language, "SAMPLE_ROWS", 300)
    few = language.sample_windows(docs, "doc_id", "text", "lang", F.lit(True))
    assert {lang for _, lang in few} == {lang for _, _, lang in rows} and sum(lang == "big" for _, lang in few) < 30


def test_query_over_the_whole_table_against_plain_python(spark, sf_small):
    """The sample chosen row by row, and every text's result by convolutions written out with that sample's network."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "lang").collect()]
    hashed = {i: xxhash.xxh64_intdigest(str(i).encode(), 42) for i, _, _ in rows}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    by_lang = defaultdict(list)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and text is not None:
            by_lang[lang].append((i, text.encode()))
    windows = []
    for lang, own in by_lang.items():
        least = min(signed(hashed[i]) for i, _ in own)
        for i, text in own:
            if hashed[i] % (1 << 20) / (1 << 20) < language.ROWS_PER_LANGUAGE / len(own) or signed(hashed[i]) == least:
                parts = [text[k : k + language.WINDOW] for k in range(0, len(text), language.WINDOW)]
                parts = [x for x in parts if any(c.isalpha() for c in x.decode("utf-8", "replace"))]
                windows += [(x, lang) for x in parts[:: max(1, len(parts) // language.WINDOWS_PER_TEXT)][: language.WINDOWS_PER_TEXT]]
    net, texts = language.train(sorted(windows)), {i: (t or "").encode() for i, t, _ in rows}
    got = queries.op9_language(spark, sf_small).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        logits = direct(net, texts[r["doc_id"]])
        p = np.exp(logits - logits.max())
        assert r["lang_pred"] == net.languages[int(p.argmax())] and r["score"] == pytest.approx(p.max() / p.sum(), abs=1e-3)
