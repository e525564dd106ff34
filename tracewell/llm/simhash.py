"""SimHash near-duplicates: Golay-code fuzzy hashing of 64-bit fingerprints.

Fingerprints are taken over 3-word shingles; two link if at most ``MAX_BITS`` = 3 bits differ, and classes are the
connected components of the links. A text without words has the fingerprint zero and is linked like any other; null
texts count as empty. Each row is a document of its own, also where ids repeat; a null id names its component only if
no other id is in it.

Candidates come from four 16-bit segments. Three errors at most leave either two segments without error, found by the
exact values of each of the six pairs, or one without error and one error in each of the others. For the latter a
segment is read as a word of the binary Golay code (23, 12), shortened by seven zero bits: it decodes to the index of
its nearest codeword, and since every 23-bit word has exactly one codeword within three errors, a word with one error
decodes to one of the at most six indices that the 16 neighbours of the true word decode to. One side of the join is
keyed by the segment without error and the index of the next segment, the other by the same segment and each of those
indices. The join verifies the bits that differ, so its output is links only.

Only distinct fingerprints are joined, so copies of a text cost nothing here, and one fingerprint has at most 43,744 links
(all numbers that differ in one to three of 64 bits), however dense its neighbourhood is.

Similar texts
-------------
``similar_documents`` is the same method for a similarity: texts link if the sets of their five-word shingles have a
Jaccard similarity of 0.8 or more, counted exactly. Such texts differ in about 15 % of the bits of a fingerprint, too
many for 64 bits and a radius. So the fingerprint has 312 bits in 13 segments of 24, and each segment is decoded by the
margins of its bits' majorities, not their signs alone, to the nearest word of the extended Golay code (24, 12). Texts
of similarity 0.8 share the index of a segment with a probability of about 0.27; a key is the indices of two segments,
of which there are 78, so that texts are compared if the errors leave any two segments that decode alike: about 0.91 of
the pairs at 0.8, 0.96 at 0.85, 0.99 at 0.9. Compared are, of texts with a key in common, those of which at most 80 bits
differ (a quarter; at 0.8 about 48 of 312 do, standard deviation 6.3).

No key's group is expanded into its pairs. Each text is first compared with one of the smallest members of its keys'
groups. Of groups that hold more than one component after that, the texts stay open that have one of another component
within 80 bits. What is similar among open texts of different components is then found exactly, by prefixes of their
sets: shingles are ordered by rarity, those of one component alone first, and two sets with an overlap of v have one in
common among the first n - v + 1 of each. The overlap a similarity needs follows from both sizes, so a prefix is taken
for each band of sizes a partner may have. A text whose prefix has only shingles of its own component costs nothing more,
and in a group of near copies that is each one which changes make less similar than that to all others. A shingle's group
is compared with its member of the most shared shingles first, and across components after that. So what shares a key, is
within 80 bits and similar is in one component in the end, and a group of copies with changes of their own costs
some comparisons a text, whether they are similar or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, map_slices, map_texts, release, written
from .graph import components
from .words import SPACE_TABLE

SHINGLE = 3
MAX_BITS = 3
SEED = 42
_POLYNOMIAL = 0xAE3
_PAIRS = list(combinations(range(4), 2))

SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
SEGMENTS = 13
SEGMENT_BITS = 24
LONGS = -(-SEGMENTS * SEGMENT_BITS // 64)
#: Bits of the long fingerprint that texts to be compared may differ in.
COMPARED_BITS = 80
#: Rows of (id, hash) that are broadcast to find the texts to be compared; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Sizes of sets are told apart by this factor when a prefix's length is taken from the size of the partner.
BAND = 1.02
_SEGMENT_PAIRS = list(combinations(range(SEGMENTS), 2))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of the shingles of ``size`` words, repeats included; of the whole sequence if it is shorter."""
    words = text.translate(SPACE_TABLE).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes) -> int:
    """Bit k is set if it is set in over half of the shingles' XXH64; repeats count."""
    return majority(shingle_hashes(text, SHINGLE))


def majority(hashes: np.ndarray) -> int:
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit segment the index it decodes to, and the indices of it and its neighbours (rows of 17, -1 where
    one is a repeat)."""

    def syndrome(words: np.ndarray) -> np.ndarray:
        out = words.copy()
        for bit in range(22, 10, -1):
            out ^= np.where(out >> bit & 1, _POLYNOMIAL << (bit - 11), 0)
        return out

    patterns = [0, *(sum(1 << b for b in c) for n in (1, 2, 3) for c in combinations(range(23), n))]
    errors = np.array(patterns, np.int64)
    leader = np.zeros(1 << 11, np.int64)
    leader[syndrome(errors)] = errors
    words = np.arange(1 << 16, dtype=np.int64) << 7
    nearest = (words ^ leader[syndrome(words)]) >> 11
    segments = np.arange(1 << 16)
    around = np.sort(np.stack([nearest, *(nearest[segments ^ (1 << b)] for b in range(16))], axis=1), axis=1)
    around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
    return nearest, around


def keys(prints: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
    """Position in ``prints`` and key, for the side that asks or the one that is asked."""
    nearest, around = golay()
    segments = [(prints >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]
    every = np.arange(len(prints))
    at, out = [], []
    for kind, (i, j) in enumerate(_PAIRS):
        at.append(every)
        out.append(kind << 32 | segments[i] << 16 | segments[j])
    for i in range(4):
        head, near = (len(_PAIRS) + i) << 32 | segments[i] << 12, segments[(i + 1) % 4]
        if query:
            found = around[near]
            rows, columns = np.nonzero(found >= 0)
            at.append(rows)
            out.append(head[rows] | found[rows, columns])
        else:
            at.append(every)
            out.append(head | nearest[near])
    return np.concatenate(at), np.concatenate(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key, fp (the fingerprint's bits as a signed long), text_hash."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        prints = np.array([fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
        yield {"key": batch.column(0), "fp": pa.array(prints), "hash": batch.column(2)}

    return map_texts(docs, id_col, text_col, "key {key}, fp long, text_hash long", work, {"text_hash": _text_hash(text_col)})


def _keyed(prints: DataFrame, query: bool) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[list]:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for lo in range(0, len(fp), 1 << 14):
            part = fp[lo : lo + (1 << 14)]
            at, key = keys(part.view(np.uint64), query)
            yield [pa.array(key), pa.array(part[at])]

    return map_slices(prints.select("fp"), "fp", "key long, fp long", work)


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most MAX_BITS bits. prints: distinct fp."""
    asked = _keyed(prints, False).toDF("k", "x")
    asking = _keyed(prints, True).toDF("key", "y")
    near = (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= MAX_BITS) & (
        (F.col("x") < F.col("y")) | ((F.col("k") >= F.lit(len(_PAIRS) << 32)) & (F.col("x") != F.col("y")))
    )
    found = asked.hint("merge").join(asking, (F.col("k") == F.col("key")) & near)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``fingerprint`` (16 lower-case hex digits), ``component_id`` (smallest id reachable), ``text_hash``
    (XXH64 of the text) and ``kept``: true for the one id and text of a component that stays for it."""
    prints = cut(fingerprints(docs, id_col, text_col))
    order = F.struct(F.col("key").isNull().alias("last"), "key", "text_hash")
    classes = cut(prints.groupBy("fp").agg(F.min(order).alias("first")))
    return _members(prints, classes, components(links(classes.select("fp"))), "fp", id_col)


@lru_cache(1)
def golay_signs() -> np.ndarray:
    """One of each two complementary words of the extended Golay code as a column of 24 signs."""
    words = np.arange(1 << 11, dtype=np.int64) << 11
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, _POLYNOMIAL << (bit - 11), 0)
    bits = ((words | rest)[:, None] >> np.arange(SEGMENT_BITS - 1)) & 1
    return (2 * np.concatenate([bits, bits.sum(axis=1, keepdims=True) % 2], axis=1) - 1).astype(np.float32).T.copy()


def decode(margins: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword for rows of 24 margins, whole numbers below 2^19, so that sums are exact."""
    signs, out = golay_signs(), np.empty(len(margins), np.uint16)
    for lo in range(0, len(margins), 512):
        product = margins[lo : lo + 512].astype(np.float32) @ signs
        best = np.abs(product).argmax(axis=1)
        out[lo : lo + 512] = 2 * best + (product[np.arange(len(best)), best] < 0)
    return out


def margins(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the long fingerprint, how many more of the hashes set it than don't."""
    n, counts = len(hashes), np.zeros(64 * LONGS, np.int64)
    for at in range(0, n, 1 << 13):
        part = hashes[at : at + (1 << 13), None] + np.arange(LONGS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        part = (part ^ (part >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(31)
        counts += np.unpackbits(part.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return 2 * counts - n


def _long_fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Per row: key, class (XXH64 of the sorted set of shingles), p0 to p4 (the bits), codes (indices of the segments),
    text_hash."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        sets = [np.unique(shingle_hashes(t, size)) for t in as_bytes(batch.column(1))]
        classes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        most = np.stack([margins(s) for s in sets])
        shift = np.array([max(0, len(s).bit_length() - 19) for s in sets])[:, None]
        used = (most >> shift)[:, : SEGMENTS * SEGMENT_BITS].reshape(-1, SEGMENT_BITS)
        codes = decode(used).astype("<u2").reshape(len(sets), SEGMENTS)
        bits = np.packbits(most > 0, axis=1, bitorder="little").view("<i8")
        yield {
            "key": batch.column(0),
            "class": pa.array(classes),
            **{f"p{k}": pa.array(np.ascontiguousarray(bits[:, k])) for k in range(LONGS)},
            "codes": pa.array([c.tobytes() for c in codes], pa.binary()),
            "hash": batch.column(2),
        }

    longs = "".join(f"p{k} long, " for k in range(LONGS))
    schema = f"key {{key}}, class long, {longs}codes binary, text_hash long"
    return map_texts(docs, id_col, text_col, schema, work, {"text_hash": _text_hash(text_col)}, 1 << 20)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def _segment_keys(classes: DataFrame) -> DataFrame:
    """k, class: for each pair of segments its number and both indices."""

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, SEGMENTS).astype(np.int64)
        found = [kind << 24 | codes[:, i] << 12 | codes[:, j] for kind, (i, j) in enumerate(_SEGMENT_PAIRS)]
        number = batch.column(0).to_numpy(zero_copy_only=False)
        yield [pa.array(np.concatenate(found)), pa.array(np.tile(number, len(found)))]

    return map_slices(classes.select("class", "codes"), "codes", "k long, class long", work, 1 << 18)


def _bits(classes: DataFrame, suffix: str) -> DataFrame:
    return classes.select(F.col("class").alias(suffix), *[F.col(f"p{k}").alias(f"{suffix}{k}") for k in range(LONGS)])


def _close() -> Column:
    differing = [F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(LONGS)]
    return sum(differing[1:], differing[0]) <= COMPARED_BITS


def _shingle_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """class, hashes: the sets of shingles of the wanted classes."""

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        sets = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in as_bytes(batch.column(1))]
        yield [batch.column(0), pa.array(sets, pa.list_(pa.int64()))]

    wanted = cut(
        wanted.select("class").distinct().join(classes, "class")
        .select("class", F.col("first.key").alias("_key"), F.col("first.text_hash").alias("_hash"))
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), _text_hash(text_col).alias("_found"))
    asked = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("merge")
    found = texts.join(asked, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_found") == F.col("_hash"))).select("class", "_text")
    return written(map_slices(found, "_text", "class long, hashes array<long>", work, 1 << 20).dropDuplicates(["class"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets of shingles are similar, counted exactly."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def _mixed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of more than one part, with the part that has the most rows: _keys, main."""
    counts = rows.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(*keys).agg(F.max(F.struct("n", "part")).alias("most"), F.count(F.lit(1)).alias("parts"))
    return cut(groups.where("parts > 1").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("most.part").alias("main")))


def _parts(classes: DataFrame, joined: DataFrame) -> DataFrame:
    """The columns of ``classes`` and part, the smallest class that ``joined`` links each to."""
    return classes.join(joined, F.col("class") == F.col("node"), "left").select(*classes.columns, F.coalesce("root", "class").alias("part"))


def _open(shared: DataFrame, classes: DataFrame, joined: DataFrame) -> DataFrame:
    """Classes with one of another component within COMPARED_BITS in one of their keys' groups. Members of a group's
    largest component are held against the others only."""
    placed = cut(_parts(shared.select("k", "class"), joined))
    rows = placed.join(_mixed(placed, ["k"]), F.col("k") == F.col("_k")).select("k", "class", "part", "main")
    first, second = _bits(classes, "a"), _bits(classes, "b")
    a = cut(rows.join(first, F.col("class") == F.col("a")).select("k", "part", "main", *first.columns))
    b = a.toDF("k_b", "part_b", "main_b", *second.columns)
    near = (F.col("k") == F.col("k_b")) & (F.col("part") != F.col("part_b")) & _close()
    beside, inside = b.where("part_b != main_b"), b.where("part_b = main_b")
    found = a.hint("merge").join(beside.hint("merge"), near, "left_semi").select("a")
    more = a.where("part != main").hint("merge").join(inside.hint("merge"), near, "left_semi").select("a")
    return found.unionAll(more).select(F.col("a").alias("class"))


def band(n: int) -> int:
    return int(log(n) / log(BAND))


@lru_cache(1 << 16)
def prefixes(n: int, similarity: float) -> tuple[int, list[tuple[int, int]]]:
    """For a set of n items: the length of the prefix that partners of n or more items meet, and, for each band with sizes
    up to n that can be similar, the length of the prefix that meets those of partners in that band."""

    def first(other: int) -> int:
        return n - ceil(similarity / (1 + similarity) * (n + other) - 1e-9) + 1

    least: dict[int, int] = {}
    at = ceil(similarity * n - 1e-9)
    while at <= n:
        least.setdefault(band(at), at)
        at = max(at + 1, int(BAND ** (band(at) + 1)) - 1)
    return first(n), [(k, first(other)) for k, other in least.items()]


def _postings(sets: DataFrame, joined: DataFrame, similarity: float) -> DataFrame:
    """h, band, class, part, n (the set's size), alone (how many of its shingles no other component has), at (the place of h in
    it by rarity), indexed (whether larger partners meet it there). Shingles of one component alone come first in every
    set and aren't returned, as nothing meets them."""

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        out: list[list] = [[] for _ in range(8)]
        for name, part, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            alone, (shown, looked) = n - len(own), prefixes(n, similarity)
            for k, length in looked:
                for at in range(alone, length):
                    row = (own[at - alone], k, name, part, n, alone, at, k == band(n) and at < shown)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
        yield out

    rows = _parts(sets, joined).select("class", "part", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    common = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    kept = rows.hint("merge").join(cut(common.select(F.col("h").alias("_h"), "df")), F.col("h") == F.col("_h"))
    own = kept.groupBy("class", "part", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("own")).select("class", "part", "n", "own.h")
    return map_slices(own, "h", "h long, band int, class long, part long, n int, alone int, at int, indexed boolean", work, 1 << 18)


def _across(sets: DataFrame, joined: DataFrame, similarity: float) -> DataFrame:
    """Links that join the components of ``joined`` and what is similar among the classes of ``sets``."""
    keys = ["h", "band"]

    def pairs(shown: DataFrame, looking: DataFrame) -> DataFrame:
        shown = shown.select(*[F.col(c).alias(f"{c}_x") for c in (*keys, "class", "part", "n", "at")])
        need = similarity / (1 + similarity) * (F.col("n") + F.col("n_x")) - 1e-9
        may = F.least(F.col("n") - F.col("at"), F.col("n_x") - F.col("at_x")) >= need
        near = (F.col("h") == F.col("h_x")) & (F.col("band") == F.col("band_x")) & (F.col("n_x") <= F.col("n")) & (F.col("part") != F.col("part_x")) & may
        return looking.hint("merge").join(shown, near).select(F.least("class", "class_x").alias("a"), F.greatest("class", "class_x").alias("b"))

    postings = cut(_postings(sets, joined, similarity))
    best = F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), "class", "part", "n", "at")).alias("best")
    central = cut(postings.where("indexed").groupBy(*keys).agg(best).select(*keys, "best.*"))
    stars = cut(pairs(central, postings).distinct())
    joined = components(joined.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(_verified(stars, sets, similarity)))

    rows = cut(_parts(postings.drop("part"), joined))
    rows = cut(rows.join(_mixed(rows, keys), [F.col(k) == F.col(f"_{k}") for k in keys]).drop("_h", "_band"))
    beside, shown = F.col("part") != F.col("main"), rows.where("indexed")
    rest = pairs(shown.where(beside), rows).unionAll(pairs(shown, rows.where(beside))).distinct()
    found = _verified(cut(rest.join(stars, ["a", "b"], "left_anti")), sets, similarity)
    return joined.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(found)


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """Per row: id, ``component_id`` (smallest id reachable), ``text_hash`` and ``kept``, as of ``near_duplicates``, for
    links by the similarity of the sets of shingles. Texts with the same set, texts without words too, are one class."""
    prints = cut(_long_fingerprints(docs, id_col, text_col, size))
    order = F.struct(F.col("key").isNull().alias("last"), "key", "text_hash")
    classes = cut(prints.groupBy("class").agg(F.min(order).alias("first"), *[F.min(c).alias(c) for c in (*[f"p{k}" for k in range(LONGS)], "codes")]))
    keyed = _segment_keys(classes)
    least = keyed.groupBy("k").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most").select(F.col("k").alias("key"), "least")
    shared = cut(keyed.hint("merge").join(least, F.col("k") == F.col("key")).select("k", "class", "least"))
    release(docs.sparkSession)
    first, second = _bits(classes, "a"), _bits(classes, "b")

    stars = shared.where("least < class").select(F.col("least").alias("a"), F.col("class").alias("b")).distinct()
    stars = stars.join(first, "a").join(second, "b").where(_close()).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    stars = cut(stars)
    sets = _shingle_sets(stars.select(F.col("a").alias("class")).unionAll(stars.select("b")), classes, docs, id_col, text_col, size)
    joined = components(_verified(stars, sets, similarity))
    release(docs.sparkSession)
    open_ = _open(shared, classes, joined)
    links_ = _across(_shingle_sets(open_, classes, docs, id_col, text_col, size), joined, similarity)
    joined = components(links_)
    release(docs.sparkSession)
    return _members(prints, classes, joined, "class", id_col).select(id_col, "component_id", "text_hash", "kept")


def _members(prints: DataFrame, classes: DataFrame, joined: DataFrame, node: str, id_col: str) -> DataFrame:
    """The rows of ``prints`` with their component, whose first member stays. joined: of ``components``."""
    members = joined.unionAll(joined.select("root", "root").distinct())
    firsts = members.join(classes, members["node"] == classes[node]).groupBy("root").agg(F.min("first").alias("component"))
    moved = members.join(firsts, "root").select("node", "component")
    placed = cut(
        classes.join(moved, classes[node] == moved["node"], "left").select(F.col(node).alias("print"), F.coalesce("component", "first").alias("component"))
    )  # as a table of its own, so that adaptive execution can split a class with many copies in the join below
    return prints.join(placed, F.col(node) == F.col("print")).select(
        F.col("key").alias(id_col),
        *([F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")] if node == "fp" else []),
        F.col("component.key").alias("component_id"),
        "text_hash",
        (F.col("key").eqNullSafe(F.col("component.key")) & F.col("text_hash").eqNullSafe(F.col("component.text_hash"))).alias("kept"),
    )
