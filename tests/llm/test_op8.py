import hashlib
import random

import pytest
from tracewell.llm import decontaminate, queries

from .cases import empty, frame, nasty_rows, sentence
from .test_op7 import words


def brute(rows, items, window=13):
    found = {}
    for i, t in items:
        ws = words(t)
        size = min(window, len(ws))
        for k in range(len(ws) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(tuple(ws[k : k + size]), set()).add(i)
    out = []
    for d, t in rows:
        ws, hit, own = words(t), set(), set()
        for size, by in found.items():
            for k in range(len(ws) - size + 1):
                if (w := tuple(ws[k : k + size])) in by:
                    hit |= set(range(k, k + size))
                    own |= by[w]
        out.append((d, len(ws), len(hit), sorted(own, key=str)))
    return sorted(map(repr, out))


def check(df, rows, items, window=13):
    got = []
    for r in df.collect():
        assert sum(s["to"] - s["from"] for s in r["spans"]) == r["n_hit"]
        got.append(repr((r["doc_id"], r["n_words"], r["n_hit"], sorted(set(r["items"]), key=str))))
        assert len(set(r["items"])) == len(r["items"])
    assert sorted(got) == brute(rows, items, window)


def cases():
    rng = random.Random(8)
    passage = sentence(rng, 40)
    items = [(1, passage), (2, sentence(rng, 13)), (3, "alpha beta"), (4, None), (5, "?!"), (6, passage), (7, "only"), (8, "a a a a a a a a a a a a a a a"), (3, "gamma delta alpha")]
    w = passage.split()
    rows = [*nasty_rows(), (40, "x " + " ".join(w[5:18]) + " y"), (41, " ".join(w[5:17])), (42, passage + " " + passage), (43, "a " * 60), (44, "Only"), (45, " ".join(w[:13])), (46, " ".join(w[-13:]))]
    return rows, items


@pytest.mark.parametrize(("clash", "block"), [(False, 4 << 20), (True, 4 << 20), (False, 100)])
def test_windows(spark, clash, block):
    rows, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    check(decontaminate.find_contamination(frame(spark, rows, clash), benchmark, block_bytes=block), rows, items)


@pytest.mark.parametrize("window", [1, 3, 6, 20])
def test_other_lengths(spark, window):
    rows, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    check(decontaminate.find_contamination(frame(spark, rows), benchmark, window=window), rows, items, window)


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(empty(spark), items).count() == 0
    rows = decontaminate.find_contamination(frame(spark, nasty_rows()), items).collect()
    assert len(rows) == len(nasty_rows()) and {r["n_hit"] for r in rows} == {0}


def test_query(spark, sf_mid):
    read = lambda t, i: [(r[0], r[1]) for r in spark.read.parquet(f"{sf_mid}/{t}.parquet").select(i, "text").collect()]
    rows, items = read("documents", "doc_id"), read("benchmark", "item_id")
    want = {eval(x)[0]: eval(x) for x in brute(rows, items)}
    got = queries.op8_decontaminate(spark, sf_mid).collect()
    assert len(got) == len(rows) and any(r["contaminated"] for r in got)
    for r in got:
        _, n, hit, own = want[r["doc_id"]]
        sha = hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(own), sha, hit > 0 and 20 * hit >= n)
