"""Hidden Markov language model over whole texts, with exact corpus counts.

Tokens are words (runs of bytes other than 0x20 and 0x09 to 0x0D, A-Z lower-cased) and one end for each text. A token
belongs to a class: the end, one of the OWN most frequent training words, or one of SHAPES classes by a word's length,
first and last characters. States emit classes; a word of a shape class then has the probability
(c + 1) / (class total + class vocabulary + 1), with c its training count. So the model has a fixed size and still gives
every word a probability.

1.  Word counts over all training texts are aggregated per batch, then by word, and written.
2.  Classes' totals are summed over that table.
3.  Every text is tokenised once more and written as its classes (two bytes a token) with the parts of its scores that
    need no model. All later passes read that table, not the texts. Counts of the KNOWN most frequent words are
    broadcast for this.
4.  Starting values come from a few rounds on START_TEXTS texts chosen by a hash (windows of START_TOKENS tokens), then
    Baum-Welch rounds run over all training texts, each partition's expected counts summed by state and class, until a
    round raises the log10 likelihood of a token by less than SETTLED.
5.  Scaled forward recursion gives each text's exact log likelihood. Words that aren't broadcast are joined with the
    table of counts by word.

A null text counts as empty: it has the end token alone. Rows with equal id and text are scored once and repeated.
Without any training text every count is 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log10
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_slices, map_texts, slices, written
from .words import byte_offsets, ranges, split_words

STATES = 8
OWN = 4096
SHAPES = 1024
#: Words, at most, whose counts are broadcast.
KNOWN = 200_000
#: Rounds end when one raises the log10 likelihood of a training token by less than this.
SETTLED = 0.002
START_TEXTS = 600
START_TOKENS = 256
START_ROUNDS = 12
#: Tokens whose state probabilities are in memory at once, but for one longer text.
TOKENS = 300_000
#: Bytes of text that are tokens at once: a token takes several times its bytes.
LOT = 6 << 20
#: Bytes of classes that sequences are chosen from at once: the more, the more of them have like lengths.
CLASS_LOT = 6 << 20
END = b"\n"


def shapes_of(words: pa.Array) -> np.ndarray:
    """Classes, from 0, of words that have none of their own."""
    data, offsets = byte_offsets(words)
    first, end = offsets[:-1], offsets[1:]
    length = end - first
    at = np.full(len(words), 2166136261, np.uint64)
    mixed = lambda c: (at ^ c.astype(np.uint64)) * np.uint64(16777619) & np.uint64(0xFFFFFFFF)
    if len(words):
        at = mixed(np.minimum(length, 12))
        at = mixed(np.minimum(data[first], 128))
        for back in (3, 2, 1):
            at = np.where(length >= back, mixed(data[np.maximum(end - back, 0)]), at)
    return ((at >> np.uint64(7)) % np.uint64(SHAPES)).astype(np.int64)


def shape_of(word: bytes) -> int:
    return int(shapes_of(pa.array([word], pa.binary()))[0])


@dataclass
class Vocabulary:
    """The KNOWN words by falling count, the end's count, and totals."""

    words: list[bytes]
    counts: np.ndarray
    ends: int
    total: int
    distinct: int

    def classes(self) -> np.ndarray:
        own = min(OWN, len(self.words))
        return np.concatenate([np.arange(1, own + 1), 1 + OWN + shapes_of(pa.array(self.words[own:], pa.binary()))])


@dataclass
class Model:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # by class, then state


CLASSES = 1 + OWN + SHAPES


def count_tokens(docs: DataFrame, id_col: str, text_col: str, learn: Column) -> DataFrame:
    """word, c over the training texts, written; the end is among them."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        counted = split_words(batch.column(1))[0].value_counts()
        yield {"word": counted.field(0), "n": counted.field(1)}
        yield {"word": [END], "n": [batch.num_rows]}

    return cut(map_texts(docs.where(learn), id_col, text_col, "word binary, n long", work, most=LOT).groupBy("word").agg(F.sum("n").alias("c")))


def read_vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """The most frequent words: all that reach the least count (in steps of an eighth of a power of two) that at most
    ``known`` words reach."""
    step = F.floor(F.log2(F.col("c")) * 8).cast("int")
    rows = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("c")).orderBy(F.desc("step")).collect()
    total, distinct, reached, least = sum(r["c"] for r in rows), sum(r["words"] for r in rows), 0, None
    for r in rows:
        reached += r["words"]
        if reached > known:
            break
        least = r["step"]
    ends = counts.where(F.col("word") == F.lit(END)).select("c").collect()
    if least is None:
        return Vocabulary([], np.zeros(0, np.int64), ends[0][0] if ends else 0, total, distinct)
    table = counts.where((step >= least) & (F.col("word") != F.lit(END))).toArrow()
    found = sorted(zip(table.column(1).to_pylist(), table.column(0).to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    return Vocabulary([w for _, w in found], np.array([c for c, _ in found], np.int64), ends[0][0] if ends else 0, total, distinct)


def class_totals(counts: DataFrame, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and words of each shape class; as many rows as classes."""
    shared = counts.sparkSession.sparkContext.broadcast([*own, END])

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        away = pc.invert(pc.is_in(batch.column(0), pa.array(shared.value, pa.binary())))
        shapes = shapes_of(batch.column(0).filter(away))
        words = np.bincount(shapes, minlength=SHAPES)
        tokens = np.zeros(SHAPES, np.int64)
        np.add.at(tokens, shapes, batch.column(1).filter(away).to_numpy(zero_copy_only=False))
        k = np.flatnonzero(words)
        yield [k, tokens[k], words[k]]

    summed = map_slices(counts, "word", "k int, tokens long, words long", work).groupBy("k").agg(F.sum("tokens").alias("t"), F.sum("words").alias("w"))
    tokens, words = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in summed.collect():
        tokens[r["k"]], words[r["k"]] = r["t"], r["w"]
    return tokens, words


class Packed:
    """Sequences of classes side by side: all first tokens, then all second ones, the longest sequence first."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        by_length = lengths[self.order]
        self.active = np.bincount(by_length, minlength=by_length[0] + 1)[::-1].cumsum()[::-1][1:]
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        begin = np.concatenate([[0], np.cumsum(lengths)])[self.order]
        self.step = ranges(np.zeros(len(lengths), np.int64), by_length)
        self.place = self.at[self.step] + np.repeat(np.arange(len(lengths)), by_length)
        self.classes = np.empty(len(flat), np.int64)
        self.classes[self.place] = flat[np.repeat(begin, by_length) + self.step]


def forward(model: Model, p: Packed, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Scale of each token, and the scaled state probabilities if ``keep``."""
    scales = np.empty(len(p.classes))
    held = np.empty((len(p.classes), len(model.start))) if keep else None
    emitted = model.emits[p.classes]
    state = None
    at = p.at.tolist()
    for t, n in enumerate(p.active.tolist()):
        lo, hi = at[t], at[t + 1]
        state = (model.start if t == 0 else state[:n] @ model.moves) * emitted[lo:hi]
        total = state.sum(axis=1)
        scales[lo:hi] = total
        state /= total[:, None]
        if keep:
            held[lo:hi] = state
    return scales, held


def log_likelihoods(model: Model, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 of each sequence's probability."""
    out = np.empty(len(lengths))
    for which, part, size in _parts(flat, lengths):
        p = Packed(part, size)
        logs = np.log10(forward(model, p, False)[0])
        sums = np.bincount(np.repeat(np.arange(len(size)), size[p.order]), weights=logs[p.place], minlength=len(size))
        out[which[p.order]] = sums
    return out


def _parts(flat: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sequences, longest first, in lots of about TOKENS tokens: which, and their tokens and lengths."""
    order = np.argsort(-lengths, kind="stable")
    begin = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(order):
        reach = np.cumsum(lengths[order[at:]])
        stop = at + max(1, int(np.searchsorted(reach, TOKENS, side="right")))
        which = order[at:stop]
        yield which, flat[ranges(begin[which], lengths[which])], lengths[which]
        at = stop


def expected_counts(model: Model, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of starts, moves and emissions (by class, then state)."""
    return expect(model, flat, lengths)[:3]


def expect(model: Model, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The same, and the log10 likelihood under ``model``."""
    k = len(model.start)
    starts, moves, emits, likely = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k)), 0.0
    for _, part, size in _parts(flat, lengths):
        p = Packed(part, size)
        scales, states = forward(model, p, True)
        likely += float(np.log10(scales).sum())
        weighted = model.emits[p.classes] / scales[:, None]
        at = p.at.tolist()
        active = p.active.tolist()
        later = None
        crossed = np.zeros((k, k))
        for t in range(len(active) - 1, -1, -1):
            lo, hi = at[t], at[t + 1]
            if later is None:
                here = np.ones((active[t], k))
            else:
                crossed += states[lo : lo + len(later)].T @ later
                here = np.ones((active[t], k))
                here[: len(later)] = later @ model.moves.T
            later = weighted[lo:hi] * here
            states[lo:hi] *= here
        moves += crossed * model.moves
        starts += states[: active[0]].sum(axis=0)
        for s in range(k):
            emits[:, s] += np.bincount(p.classes, weights=states[:, s], minlength=CLASSES)
    return starts, moves, emits, likely


def maximise(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Model:
    """Probabilities from counts; classes that a state never had get a little by their overall share."""
    overall = (emits.sum(axis=1) + 0.5) / (emits.sum() + 0.5 * len(emits))
    smooth = emits + 20.0 * overall[:, None]
    return Model(
        (starts + 0.1) / (starts + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True), smooth / smooth.sum(axis=0, keepdims=True)
    )


def start_model(sequences: list[np.ndarray], states: int = STATES, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    flat = np.concatenate(sequences) if sequences else np.zeros(0, np.int64)
    share = np.bincount(flat, minlength=CLASSES) + 0.1
    emits = share[:, None] * rng.uniform(0.5, 1.5, (CLASSES, states))
    model = Model(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emits / emits.sum(axis=0))
    lengths = np.array([len(s) for s in sequences], np.int64)
    for _ in range(START_ROUNDS if len(sequences) else 0):
        model = maximise(*expected_counts(model, flat, lengths))
    return model


class Coder:
    """Words as numbers and classes, by the broadcast vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.words = pa.array(vocabulary.words, pa.binary())
        self.classes = vocabulary.classes()
        self.logs = np.log10(vocabulary.counts + 1)
        self.end_log, self.end_known = log10(vocabulary.ends + 1), int(vocabulary.ends > 0)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of each word its class and log10(count + 1), 0 if its count isn't known; which those are, their numbers in the
        list of different ones, and that list."""
        found = pc.index_in(words, self.words)
        away = np.flatnonzero(pc.is_null(found).to_numpy(zero_copy_only=False))
        number = pc.fill_null(found, 0).to_numpy(zero_copy_only=False)
        some = len(self.classes) > 0
        classes, logs = (self.classes[number], self.logs[number]) if some else (np.zeros(len(number), np.int64), np.zeros(len(number)))
        others = words.take(pa.array(away)).dictionary_encode()
        which = others.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        classes[away] = (1 + OWN + shapes_of(others.dictionary))[which]
        logs[away] = 0.0
        return classes, logs, away, which, others.dictionary


_CODERS: dict[str, Coder] = {}


def _coder(shared) -> Coder:
    if shared.id not in _CODERS:
        _CODERS.clear()
        _CODERS[shared.id] = Coder(shared.value)
    return _CODERS[shared.id]


class _Shared:
    """A broadcast with a number that workers know its decoded form by."""

    def __init__(self, spark, value) -> None:
        self.broadcast, self.id = spark.sparkContext.broadcast(value), uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


ENCODED = "key {key}, hash long, learn boolean, classes binary, tokens long, known long, base double, score double, words array<binary>, times array<bigint>"


def encode_texts(docs: DataFrame, id_col: str, text_col: str, learn: Column, shared: _Shared, class_logs: np.ndarray) -> DataFrame:
    """Per row: key, hash of the text, learn, its classes as 16-bit numbers, number of tokens, and, over the known words
    alone, how many have a count and the sums that the base score and the score of words within classes need; then the
    other words and how often the text has each. Written."""
    logs_of_classes = docs.sparkSession.sparkContext.broadcast(class_logs)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        coder, vocabulary = _coder(shared), shared.value
        scale = log10(vocabulary.total + vocabulary.distinct + 1)
        words, size = split_words(batch.column(1))
        n = len(size)
        if not n:
            return
        classes, logs, away, which, others = coder(words)
        owner = np.repeat(np.arange(n), size)
        shaped = np.flatnonzero(classes > OWN)
        within = logs[shaped] - logs_of_classes.value[classes[shaped] - 1 - OWN]
        summed = lambda at, x: np.bincount(owner[at], weights=x, minlength=n)
        # Each text's end follows its words, in class 0.
        stored = np.zeros(len(classes) + n, np.uint16)
        stored[np.arange(len(classes)) + owner] = classes
        ends = np.cumsum(2 * (size + 1))
        pairs, times = np.unique(owner[away] * max(1, len(others)) + which, return_counts=True)
        rows = np.searchsorted(pairs, np.arange(n + 1) * max(1, len(others))).astype(np.int32)
        yield {
            "key": batch.column(0),
            "hash": batch.column(2),
            "learn": batch.column(3),
            "classes": pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(stored.astype("<u2"))]),
            "tokens": size + 1,
            "known": size - np.bincount(owner[away], minlength=n) + coder.end_known,
            "base": summed(slice(None), logs) + coder.end_log - (size + 1) * scale,
            "score": summed(shaped, within),
            "words": pa.ListArray.from_arrays(pa.array(rows), others.take(pa.array(pairs % max(1, len(others))))),
            "times": pa.ListArray.from_arrays(pa.array(rows), pa.array(times)),
        }

    text_hash = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return written(map_texts(docs, id_col, text_col, ENCODED, work, {"hash": text_hash, "learn": F.coalesce(learn, F.lit(False))}, LOT), "hmm")


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts one after another, and how many each has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), "<u2").astype(np.int64), np.fromiter(map(len, parts), np.int64, len(parts)) // 2


def start_sequences(encoded: DataFrame, n: int) -> list[np.ndarray]:
    """The middles of about START_TEXTS of n training texts, in an order that doesn't depend on partitions."""
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    middle = F.greatest(F.lit(0), F.floor((F.col("tokens") - START_TOKENS) / 2)) * 2 + 1
    rows = encoded.where(F.col("learn") & (hashed < START_TEXTS / max(1, n))).select(F.substring("classes", middle.cast("int"), F.lit(2 * START_TOKENS))).collect()
    return [np.frombuffer(c, "<u2").astype(np.int64) for c in sorted(bytes(r[0]) for r in rows)]


def baum_welch(encoded: DataFrame, model: Model) -> tuple[Model, float]:
    """The model after a round over all training texts, and the log10 likelihood before it. A task gives one row for each
    count that isn't zero, whatever the number of its texts."""
    states = len(model.start)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(states + states * states + CLASSES * states + 1)
        for whole in batches:
            for batch in slices(whole, "classes", CLASS_LOT):
                starts, moves, emits, likely = expect(shared.value, *_sequences(batch.column(0)))
                total += np.concatenate([starts, moves.ravel(), emits.ravel(), [likely]])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    parts = encoded.where("learn").select("classes").mapInArrow(run, "at int, n double")
    summed = parts.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(states + states * states + CLASSES * states + 1)
    counts[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    moves = counts[states : states + states**2].reshape(states, states)
    return maximise(counts[:states], moves, counts[states + states**2 : -1].reshape(CLASSES, states)), float(counts[-1])


def train(encoded: DataFrame, texts: int, tokens: int, states: int = STATES, settled: float = SETTLED) -> tuple[Model, list[float]]:
    """The model, and the log10 likelihood of a training token before each round. texts, tokens: of the training texts."""
    model, likely = start_model(start_sequences(encoded, texts), states), []
    while texts:
        model, total = baum_welch(encoded, model)
        likely.append(total / tokens)
        if len(likely) > 1 and likely[-1] - likely[-2] < settled:
            break
    return model, likely


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None, states: int = STATES, settled: float = SETTLED) -> DataFrame:
    """Per row: id, ``n_tokens``, ``n_known`` (tokens with a count), ``train_tokens``, ``base_score`` (add-one unigram
    model) and ``score`` (hidden Markov model), both log10 probabilities."""
    learn = F.lit(True) if learn is None else learn
    counts = count_tokens(docs, id_col, text_col, learn)
    vocabulary = read_vocabulary(counts)
    tokens, words = class_totals(counts, vocabulary.words[:OWN])
    encoded = encode_texts(docs, id_col, text_col, learn, _Shared(docs.sparkSession, vocabulary), np.log10(tokens + words + 1))
    model, _ = train(encoded, vocabulary.ends, vocabulary.total, states, settled)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        if batch.num_rows:
            likely = log_likelihoods(shared.value, *_sequences(batch.column(0)))
            yield [*batch.columns[1:-1], pa.array(batch.column(batch.num_columns - 1).to_numpy() + likely)]

    kind = dict(encoded.dtypes)["key"]
    schema = f"key {kind}, hash long, tokens long, known long, base double, score double"
    heads = map_slices(encoded.select("classes", "key", "hash", "tokens", "known", "base", "score"), "classes", schema, work, CLASS_LOT)
    others = encoded.select("key", "hash", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("n"))))
    joined = others.join(counts.hint("merge"), "word").where("c > 0")
    nothing = lambda *names: [F.lit(None).cast("double" if n in ("base", "score", "logs") else "long").alias(n) for n in names]
    summed = (
        heads.select("*", *nothing("more", "logs"))
        .unionByName(joined.select("key", "hash", *nothing("tokens", "known", "base", "score"), F.col("n").alias("more"), (F.col("n") * F.log10(F.col("c") + 1)).alias("logs")))
        .groupBy("key", "hash")
        .agg(
            F.count("tokens").alias("times"),
            F.max("tokens").alias("n_tokens"),
            F.max("known").alias("known"),
            F.max("base").alias("base"),
            F.max("score").alias("score"),
            F.coalesce(F.sum("more"), F.lit(0)).alias("more"),
            F.coalesce(F.sum("logs"), F.lit(0.0)).alias("logs"),
        )
    )
    each = summed.select("*", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_"))
    return each.select(
        F.col("key").alias(id_col),
        "n_tokens",
        (F.col("known") + (F.col("more") / F.col("times")).cast("long")).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") / F.col("times")).alias("base_score"),
        (F.col("score") + F.col("logs") / F.col("times")).alias("score"),
    )
