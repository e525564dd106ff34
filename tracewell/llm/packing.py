"""Best-fit packing of documents into fixed-length token sequences, with certified bin counts.

A document is its token ids and one end id. One longer than ``capacity`` is cut into pieces of ``capacity`` tokens, of
which the first may be shorter. Pieces are dealt evenly to partitions of about PARTITION_PIECES; each is packed by
best-fit decreasing and compared with a lower bound from dual feasible functions. A partition that meets its bound is
certified: only its emptiest sequence stays open. One with a gap keeps its full sequences and opens the others. The
pieces of open sequences are exchanged, that is dealt anew to fewer partitions, and packed again, until all of them fit
one partition or an exchange no longer lowers the number of sequences beyond the partitions' bounds; ``partition_bins``
and ``partition_bound`` tell what was left then. Sequences are numbered by round, partition and place.

A null or empty text is the end id alone. Repeated rows are packed each on its own; null ids are kept. An empty table
gives no rows. The rows of a partition are bounded by PARTITION_PIECES, and only counts reach the driver.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts
from .words import byte_offsets, ranges

CAPACITY = 2048
PARTITION_PIECES = 4096
#: Bytes of text whose ids are in memory at once.
LOT = 8 << 20
#: Different parts of text whose ids a worker remembers, but for those of one lot.
REMEMBERED = 300_000
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that can't begin white space: neither ASCII white space and separators nor the first byte of other white space.
_SOLID = np.array([c not in {32, *range(9, 14), *range(28, 32), 0x85, 0xA0, 0xC2, 0xE1, 0xE2, 0xE3} for c in range(256)])
#: ASCII letters, and ASCII characters that aren't letters.
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])
_OTHER = ~_LETTER & (np.arange(256) < 128)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(content: dict) -> dict[bytes, int] | None:
    """Ids of byte strings by which merging the pair of least id gives what the file's merges give; None if they may differ.

    That holds if ids rise along the merges and if each merged string, taken alone and with lower ids only, ends as the
    very pair that its merge names: what stands around a string can't change how it is merged inside.
    """
    model, added = content["model"], {t["content"] for t in content.get("added_tokens") or []}
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    try:
        ranks = {bytes(alphabet[c] for c in w): i for w, i in model["vocab"].items() if w not in added}
        pairs = [tuple(bytes(alphabet[c] for c in w) for w in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    except KeyError:
        return None
    ids = [ranks.get(a + b, -1) for a, b in pairs]
    if min(ids, default=0) < 0 or any(a >= b for a, b in zip(ids, ids[1:])) or len(set(ids)) + 256 != len(ranks) or not all(bytes([c]) in ranks for c in range(256)):
        return None
    for (a, b), top in zip(pairs, ids, strict=True):
        parts = [bytes([c]) for c in a + b]
        while len(parts) > 2:
            least, k = min((ranks.get(parts[k] + parts[k + 1], top), k) for k in range(len(parts) - 1))
            if least >= top:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if parts != [a, b]:
            return None
    return ranks


class Ids:
    """Token ids of many texts at once, equal to those of the file's own tokenizer.

    A byte-level split never puts a space that no white space follows, or a sign after a letter, into one piece with what
    stands before it. With a file whose ids come from such a split alone, texts are therefore cut there, each different
    part is encoded once, and parts' ids are remembered. Texts with the string of an added token, and all texts with any other file,
    are one part each. Parts go to the file's own tokenizer, but for those of characters below U+0500 where ``byte_ranks``
    shows that a quicker coder with the same split gives the same ids.
    """

    def __init__(self, file: bytes) -> None:
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_buffer(file)
        content = json.loads(file)
        split, model = content.get("pre_tokenizer") or {}, content["model"]
        self.cuts = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
            and not any(content.get(k) for k in ("normalizer", "truncation", "padding")) and model["type"] == "BPE" and not model.get("dropout")
        )
        self.added = [t["content"] for t in content.get("added_tokens") or []]
        self.quick = None
        ranks = byte_ranks(content) if self.cuts else None
        if ranks:
            import tiktoken

            self.quick = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.sizes = array("I"), array("I")

    def _learn(self, part: bytes, ids: list[int]) -> None:
        self.known[part] = len(self.sizes)
        self.ids.extend(ids)
        self.sizes.append(len(ids))

    def _parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts of all texts (none of them null), and the text of each."""
        data, offsets = byte_offsets(texts.cast(pa.binary()))
        owner_of = lambda starts: np.searchsorted(offsets, starts, side="right") - 1
        some = np.flatnonzero(np.diff(offsets))
        starts = offsets[some]
        if self.cuts and len(data):
            low, high = int(offsets[0]), int(offsets[-1])
            here, after = data[low : high - 1], data[low + 1 : high]
            at = low + np.flatnonzero(((here == 32) & _SOLID[after]) | np.append(False, _LETTER[here[:-1]] & _OTHER[after[:-1]]))
            owner = owner_of(at)
            whole = np.zeros(len(texts), bool)
            for added in self.added:
                whole |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
            inside = ~whole[owner] & (at + 1 < offsets[owner + 1])
            begins = np.zeros(high - low, bool)
            begins[starts - low] = begins[at[inside] - low] = True
            starts = low + np.flatnonzero(begins)
        ends = np.append(starts[1:], offsets[-1]) if len(starts) else starts
        parts = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, ends[-1:]).astype(np.int32)), pa.py_buffer(data)])
        return parts, owner_of(starts)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has. A null text has none."""
        parts, owner = self._parts(pc.fill_null(texts, ""))
        coded = parts.dictionary_encode()
        if len(self.known) + len(coded.dictionary) > REMEMBERED:
            self._forget()
        different = coded.dictionary.to_pylist()
        data, offsets = byte_offsets(coded.dictionary)
        near = (np.maximum.reduceat(data, offsets[:-1]) if len(different) else np.zeros(0, np.uint8)) < 0xD4
        for added in self.added:
            near &= ~pc.match_substring(coded.dictionary, added).to_numpy(zero_copy_only=False)
        far = []
        for p, quick in zip(different, near.tolist(), strict=True):
            if p not in self.known:
                if self.quick and quick:
                    self._learn(p, self.quick(p.decode()))
                else:
                    far.append(p)
        for at in range(0, len(far), 10_000):
            lot = far[at : at + 10_000]
            for p, e in zip(lot, self.own.encode_batch_fast([p.decode("utf-8", "replace") for p in lot], add_special_tokens=False), strict=True):
                self._learn(p, e.ids)
        sizes = np.array(self.sizes, np.int64)
        number = np.fromiter(map(self.known.__getitem__, different), np.int64, len(different))[coded.indices.to_numpy(zero_copy_only=False)]
        size = sizes[number]
        ids = np.array(self.ids, np.uint32)[ranges((np.cumsum(sizes) - sizes)[number], size)]
        return ids, np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)


_IDS: dict[int, Ids] = {}


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows key, piece, start, length, ids_crc32."""
    with open(path or tokenizer_path(), "rb") as f:
        content = f.read()
    stamp, shared = zlib.crc32(content), docs.sparkSession.sparkContext.broadcast(content)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        if stamp not in _IDS:
            _IDS[stamp] = Ids(shared.value)
        ids, sizes = _IDS[stamp](batch.column(1))
        ended = np.zeros(len(ids) + len(sizes), "<u4")
        ended[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
        stored = memoryview(ended).cast("B")
        row, piece, start, length, crc = [], [], [], [], []
        begin = 0
        for k, n in enumerate((sizes + 1).tolist()):
            at, size = 0, (n - 1) % capacity + 1
            number = 0
            while at < n:
                row.append(k)
                piece.append(number)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(stored[4 * (begin + at) : 4 * (begin + at + size)]))
                at, size, number = at + size, capacity, number + 1
            begin += n
        yield {"key": batch.column(0).take(pa.array(row, pa.int64())), "piece": piece, "start": start, "length": length, "crc": crc}

    return map_texts(docs, id_col, text_col, "key {key}, piece int, start long, length long, ids_crc32 long", work, most=LOT)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Positions of the lengths in each bin. Ties go to the earlier position and the bin opened last."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(k)
        else:
            room, at = capacity, len(bins)
            bins.append([k])
        room -= size
        if room:
            by_room.setdefault(room, []).append(at)
            rooms |= 1 << room
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the largest of the bounds from dual feasible functions.

    Identity; the threshold functions (items over capacity - t count whole, those under t nothing) for every t that
    occurs; and the step functions floor((k+1)x)/k for k from 1 to 8.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    weights, numbers = np.concatenate([[0], np.cumsum(sizes * counts)]), np.concatenate([[0], np.cumsum(counts)])
    low = sizes[sizes * 2 <= capacity]
    from_low = np.searchsorted(sizes, low)
    to_high = np.searchsorted(sizes, capacity - low, side="right")
    for a, b in zip(from_low.tolist(), to_high.tolist(), strict=True):
        whole = int(numbers[-1] - numbers[b])
        best = max(best, whole + -(-int(weights[b] - weights[a]) // capacity) if b >= a else best)
    for k in range(1, 9):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def pack_partition(lengths: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Bin, offset and whether the bin stays closed for each length; number of bins and their lower bound."""
    bins = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    number, offset, closed = (np.zeros(len(lengths), np.int64) for _ in range(3))
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    if last:
        shut = np.ones(len(bins), bool)
    elif len(bins) == bound:
        shut = np.ones(len(bins), bool)
        shut[fill.argmin()] = fill.min() == capacity
    else:
        shut = fill == capacity
    for k, b in enumerate(bins):
        number[b] = k
        offset[b] = np.cumsum(lengths[b]) - lengths[b]
        closed[b] = shut[k]
    return number, offset, closed, len(bins), bound


PIECE_COLUMNS = ["key", "piece", "start", "length", "ids_crc32"]


def _packer(capacity: int, last: bool, round_number: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "key", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        number, offset, closed, bins, bound = pack_partition(rows["length"].to_numpy(), capacity, last)
        first = (round_number << 58) + (int(rows["_part"].iloc[0]) << 32)
        return rows[PIECE_COLUMNS].assign(sequence_id=first + number, offset=offset, partition_bins=bins, partition_bound=bound, closed=closed)

    return packed


def _gap(out: DataFrame) -> int:
    """Sequences beyond the sum of the partitions' bounds."""
    each = out.groupBy(F.shiftright("sequence_id", 32)).agg(F.first(F.col("partition_bins") - F.col("partition_bound")).alias("gap"))
    return each.agg(F.coalesce(F.sum("gap"), F.lit(0))).first()[0]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    partition_pieces: int = PARTITION_PIECES,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and the bins and bound of its partition
    (``partition_bins``, ``partition_bound``)."""
    columns = PIECE_COLUMNS
    pool = cut(cut_pieces(docs, id_col, text_col, path, capacity))
    kind = dict(pool.dtypes)["key"]
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, partition_bins long, partition_bound long, closed long"
    done, gap, round_number = [], None, 0
    while True:
        n = pool.count()
        last = n <= partition_pieces
        parts = max(1, -(-n // partition_pieces))
        dealt = pool.select(*columns, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).alias("_part"))
        out = cut(dealt.groupBy("_part").applyInPandas(_packer(capacity, last, round_number), schema))
        if not last:
            before, gap = gap, _gap(out)
            last = before is not None and gap >= before
        if last:
            done.append(out)
            break
        done.append(out.where("closed = 1"))
        pool, round_number = out.where("closed = 0").select(*columns), round_number + 1
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole.drop("closed").withColumnRenamed("key", id_col)
