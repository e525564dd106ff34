import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tracewell.llm import packing, queries

from .cases import empty, frame, nasty_rows

TOKENIZER = Tokenizer.from_file(packing.tokenizer_path())


IDS = packing.Ids(open(packing.tokenizer_path(), "rb").read())


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


ODD = ["a  b   c ", " lead", "x\n\n  y\t z", "<|endoftext|> inside", "it's we'll I'M 'sa", "１２３ 漢字  ☃️ é", "   a", "a b  c", "no\x00null", "ends with space ", "…   …", "A1b2 C3-d4_e5 ﬁ ǅ ², ³"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_tokenizers(name):
    path = public_tokenizers.path(name)
    own, ids = Tokenizer.from_file(path), packing.Ids(open(path, "rb").read())
    texts = [*ODD, None, "", *(t or "" for _, t in nasty_rows()), "a\u00a0 \u00a0b \u3000c \u2003 d \u0085 e", " ", "  ", "x " * 3 + "\n y", "é é  é\t é"]
    want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    column = pa.array(["left out", *texts, "left out"]).slice(1, len(texts))
    for _ in range(2):
        got, sizes = ids(column)
        assert sizes.tolist() == [len(w) for w in want] and got.tolist() == [x for w in want for x in w]


@given(st.lists(st.text(st.sampled_from(" \n\t\r\u00a0\u2003\u3000\u0085\x1cab'1s.é漢<|>"), max_size=30), max_size=6))
def test_ids_of_any_texts(texts):
    got, sizes = IDS(pa.array(texts, pa.string()))
    assert got.tolist() == [x for t in texts for x in ids_of(t)[:-1]] and len(sizes) == len(texts)


def test_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    ids = packing.Ids(open(packing.tokenizer_path(), "rb").read())
    for t in ODD * 2:
        assert ids(pa.array([t]))[0].tolist() == ids_of(t)[:-1] and len(ids.known) <= max(5, len(t))


@pytest.mark.parametrize("capacity", [30, 64])
def test_lengths_whose_bins_are_rarely_full(spark, capacity):
    """Pieces of a third to a half of the capacity: exchanges end when they help no more, and nothing is lost."""
    rng = np.random.default_rng(3)
    rows = [(k, "a " * int(rng.integers(capacity // 3, capacity // 2))) for k in range(600)]
    check(rows, packing.pack(frame(spark, rows), capacity=capacity, partition_pieces=40).collect(), capacity)


def check(rows, got, capacity):
    """Pieces are whole, sequences are gapless."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, text in rows:
        ids = ids_of(text)
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        assert cuts[-1] == len(ids)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i].append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in by_seq.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_seq), sum(n for v in by_seq.values() for _, n in v)


@pytest.mark.parametrize(("capacity", "pieces", "clash"), [(2048, 4096, False), (64, 30, True), (64, 5000, False), (7, 50, False)])
def test_nasty_rows(spark, capacity, pieces, clash):
    rows = [*nasty_rows(), *[(100 + k, t) for k, t in enumerate(ODD)]]
    got = packing.pack(frame(spark, rows, clash), capacity=capacity, partition_pieces=pieces).collect()
    check(rows, got, capacity)
    for r in got:
        assert r["partition_bins"] >= r["partition_bound"]


def test_few_sequences(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    for pieces in (64, 4096):
        n, total = check(rows, packing.pack(docs, partition_pieces=pieces).collect(), 2048)
        assert n <= math.ceil(total / 2048) * 1.01 + 1


def test_query(spark, sf_small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, queries.op10_packing(spark, sf_small).collect(), 2048)


def test_empty_table(spark):
    assert packing.pack(empty(spark)).count() == 0


def slow_best_fit(lengths, capacity):
    bins = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fitting = [(capacity - sum(lengths[x] for x in b), n) for n, b in enumerate(bins) if sum(lengths[x] for x in b) + lengths[k] <= capacity]
        if fitting:
            bins[min(fitting)[1]].append(k)
        else:
            bins.append([k])
    return bins


def fewest(lengths, capacity):
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for n in range(len(rooms)):
            if rooms[n] >= lengths[k] and rooms[n] not in rooms[:n]:
                place(k + 1, [*rooms[:n], rooms[n] - lengths[k], *rooms[n + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bins_and_bounds(seed):
    rng = np.random.default_rng(seed)
    capacity = 30
    lengths = rng.integers(1, capacity + 1, 9)
    bins = packing.best_fit_decreasing(lengths, capacity)
    assert sorted(k for b in bins for k in b) == list(range(9)) and all(lengths[b].sum() <= capacity for b in bins)
    assert len(bins) == len(slow_best_fit(lengths.tolist(), capacity))
    least = fewest(sorted(lengths.tolist(), reverse=True), capacity)
    assert packing.lower_bound(lengths, capacity) <= least <= len(bins)


def test_bounds_see_more_than_the_sum():
    assert packing.lower_bound(np.array([16] * 10), 30) == 10
    assert packing.lower_bound(np.array([11] * 6), 30) == 3 and packing.lower_bound(np.zeros(0, np.int64), 30) == 0
