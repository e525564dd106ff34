import random

import numpy as np
import pytest
import xxhash
from tracewell.llm import queries, simhash

from .cases import empty, frame, nasty_rows, sentence

SPACES = b" \t\n\r\x0b\x0c"


def brute_print(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = [w for w in bytes(32 if c in SPACES else c for c in data).split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (id, fingerprint). Smallest id reachable."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, p) in enumerate(prints):
        for j in range(i):
            if bin(p ^ prints[j][1]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(prints):
        r = find(k)
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    return [(i, f"{p:016x}", None if least[find(k)][0] else least[find(k)][1]) for k, (i, p) in enumerate(prints)]


def check(df, rows):
    want = brute_components([(i, brute_print(t)) for i, t in rows])
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("clash", [False, True])
def test_nasty_rows(spark, clash):
    check(simhash.near_duplicates(frame(spark, nasty_rows(), clash)), nasty_rows())


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_whole_small_table(spark, sf_small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op3_simhash(spark, sf_small), rows)


def test_chains_of_copies(spark):
    """Each text differs from the one before it by a word."""
    rng = random.Random(3)
    words, rows = sentence(rng, 400).split(), []
    for k in range(60):
        words[rng.randrange(len(words))] = f"w{k}"
        rows.append((1000 - k, " ".join(words)))
    check(simhash.near_duplicates(frame(spark, rows)), rows)


def test_every_pair_of_three_bits_has_a_key():
    rng = np.random.default_rng(1)
    for _ in range(400):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        y = x
        for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            y ^= 1 << int(b)
        asked = set(simhash.keys(np.array([x], np.uint64), False)[1].tolist())
        asking = set(simhash.keys(np.array([y], np.uint64), True)[1].tolist())
        assert asked & asking


def test_golay_code_is_perfect():
    """Every 16-bit word with one error decodes to one of at most six indices around the true one."""
    nearest, around = simhash.golay()
    counts = (around >= 0).sum(axis=1)
    assert counts.max() <= 17 and nearest.min() >= 0 and nearest.max() < 4096
    for w in (0, 1, 513, 65535, 4097):
        for b in range(16):
            assert nearest[w ^ (1 << b)] in around[w]


def test_one_of_each_component_is_kept(spark):
    """Two texts of one id can be two components."""
    rows = [*nasty_rows(), (1, nasty_rows()[0][1])]
    kept = simhash.near_duplicates(frame(spark, rows)).where("kept").select("component_id", "text_hash").distinct()
    prints = sorted({brute_print(t) for _, t in rows})
    assert kept.count() == len({c for _, _, c in brute_components(list(enumerate(prints)))})


def shingle_set(text):
    """Five words; fewer words are one shingle."""
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_similar(rows):
    """rows: (id, text). Smallest id reachable over links of similar sets."""
    sets, label = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similar(sets[i], sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        least[x] = min(least.get(x, (True, 0)), (i is None, i or 0))
    return [(i, None if least[x][0] else least[x][1]) for (i, _), x in zip(rows, label, strict=True)]


def found_similar(df):
    return [(r["doc_id"], r["component_id"]) for r in simhash.similar_documents(df).collect()]


def changed(rng, text, share):
    words = text.split()
    for k in rng.sample(range(len(words)), int(share * len(words))):
        words[k] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("clash", [False, True])
def test_similar_nasty_rows(spark, clash):
    assert sorted(map(repr, found_similar(frame(spark, nasty_rows(), clash)))) == sorted(map(repr, brute_similar(nasty_rows())))


def test_similar_empty_table(spark):
    assert simhash.similar_documents(empty(spark)).count() == 0


def test_similar_pairs_are_found_and_others_left_alone(spark):
    """All that is linked is similar; of pairs at 0.8 to 0.85 nine in ten are linked, of closer ones nearly all."""
    rng, rows, bands = random.Random(5), [], {}
    for i in range(300):
        text = sentence(rng, 200)
        copy = changed(rng, text, rng.choice([0.005, 0.015, 0.02, 0.03, 0.06]))
        a, b = shingle_set(text), shingle_set(copy)
        rows += [(2 * i, text), (2 * i + 1, copy)]
        bands.setdefault(min(3, int(20 * (len(a & b) / len(a | b) - 0.8) // 1)), []).append(2 * i)
    got = dict(found_similar(frame(spark, rows)))
    linked = {band: sum(got[i] == got[i + 1] for i in ids) / len(ids) for band, ids in bands.items()}
    assert all(share == 0 for band, share in linked.items() if band < 0)
    assert linked[0] >= 0.88 and all(linked[band] >= 0.95 for band in (1, 2, 3) if band in linked)
    assert all(c in (i, i - i % 2) for i, c in got.items())


def test_similar_large_group(spark):
    """A group of near copies, most of them similar to each other, some only over third ones, and a second group."""
    rng = random.Random(6)
    one, two = sentence(rng, 300), sentence(rng, 300)
    rows = [(k, changed(rng, one, 0.015)) for k in range(250)] + [(1000 + k, changed(rng, two, 0.03)) for k in range(40)]
    rows += [(2000 + k, one) for k in range(30)]
    got, want = dict(found_similar(frame(spark, rows))), dict(brute_similar(rows))
    assert all(want[c] == want[i] for i, c in got.items())
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_extended_code():
    """Codewords differ in 8 bits at least; whole numbers of any sign and size decode to the nearest one."""
    signs = simhash.golay_signs()
    every = np.concatenate([signs.T, -signs.T]).astype(int)
    assert len(np.unique(every, axis=0)) == 4096
    assert sorted(set((every @ every[0]).tolist())) == [-24, -8, 0, 8, 24]
    rng = np.random.default_rng(2)
    rows = rng.integers(-500_000, 500_000, (50, 24))
    codes = simhash.decode(rows)
    assert [int(r @ (signs[:, c // 2].astype(int) * (-1 if c % 2 else 1))) for r, c in zip(rows, codes, strict=True)] == (rows @ every.T).max(axis=1).tolist()


def test_similar_pairs_meet_in_their_prefixes():
    """Sets of m <= n items with the overlap a similarity needs have a common item in the first m - v + 1 and n - v + 1."""
    for similarity in (0.5, 0.8, 1.0):
        for n in [*range(1, 260), 1000, 5001]:
            looked = dict(simhash.prefixes(n, similarity)[1])
            for m in range(-(-int(similarity * 1000) * n // 1000), n + 1):
                overlap = next(v for v in range(int(similarity / (1 + similarity) * (m + n)), m + 1) if v >= similarity * (m + n - v) - 1e-9)
                assert simhash.prefixes(m, similarity)[0] >= m - overlap + 1
                assert looked[simhash.band(m)] >= n - overlap + 1


def test_across_is_exact(spark):
    """Sets with items of their own and items many share, chains among them, without links to start from."""
    rng, sets = random.Random(7), []
    for core in (20, 60, 61):
        base = [rng.randrange(1 << 40) for _ in range(core)]
        for _ in range(45):
            base[rng.randrange(core)] = rng.choice([rng.randrange(1 << 40), rng.randrange(12)])
            kept = [h for h in base if rng.random() > rng.choice([0, 0, 0.05, 0.2])]
            sets.append(sorted({*kept, *(rng.randrange(1 << 40) for _ in range(rng.choice([0, 0, 1, 4, 12])))}))
    frame_ = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "class long, hashes array<long>").repartition(3)
    links = [(r["a"], r["b"]) for r in simhash._across(frame_, spark.createDataFrame([], "node long, root long"), 0.8).collect()]
    label, want = list(range(len(sets))), list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            for group, linked in ((label, (j, i) in links), (want, similar(set(sets[i]), set(sets[j])))):
                if linked and group[i] != group[j]:
                    group[:] = [group[j] if x == group[i] else x for x in group]
    same = lambda group: {tuple(k for k, x in enumerate(group) if x == y) for y in group}
    assert same(label) == same(want) and 10 < len(same(want)) < len(sets) - 20


def test_near_copies_cost_some_comparisons_a_text(spark, monkeypatch):
    """Copies of a text with changes of their own, half of them similar to none: the pairs compared grow with the copies."""
    rng, base, compared, verified = random.Random(8), sentence(random.Random(8), 150).split(), [], simhash._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash, "_verified", counted)
    rows = [(k, " ".join(f"w{k}x{i}" if i in places else w for i, w in enumerate(base))) for k in range(800) for places in [set(rng.sample(range(150), k % 8))]]
    rows.append((800, " ".join(base)))
    for n in (200, 800):
        compared.clear()
        got, want = dict(found_similar(frame(spark, rows[-n:]))), dict(brute_similar(rows[-n:]))
        assert all(want[c] == want[i] for i, c in got.items()) and sum(got[i] == want[i] for i in want) >= 0.98 * n
        assert 20 < len(set(want.values())) and sum(compared) <= 6 * n, (n, compared)
