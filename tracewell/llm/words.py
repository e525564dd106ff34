"""Words of whole texts as arrays of small numbers, for the set-similarity joins.

A word is a run of letters, digits and non-ASCII characters after A-Z are lower-cased, that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Work is done on UTF-8 bytes, where every byte from 0x80 belongs to a word.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lower-cases A-Z and turns bytes that belong to no word into spaces.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: The same, but line ends stay, to become tokens of their own.
LINE_TABLE = bytes(10 if c == 10 else WORD_TABLE[c] for c in range(256))

_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Lower-cases A-Z; bytes.split() then cuts at 0x20 and 0x09 to 0x0D.
SPACE_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def split_words(column: pa.Array, table: bytes = SPACE_TABLE) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another (binary), and how many each text has, without a Python object for each.
    The bytes of the texts go through ``table`` and are cut at 0x20 and 0x09 to 0x0D; a null text has no words."""
    texts = pc.fill_null(column.cast(pa.binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]).translate(table)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(plain)
    flat = lists.flatten().cast(pa.binary())
    some = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return flat.filter(some), np.diff(before[ends])


def byte_offsets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array without nulls, and where its words begin and the last one ends."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2] or b"", np.uint8), offsets.astype(np.int64)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def lines_and_words(text: bytes) -> list[bytes]:
    """Words, with b"\\x01" where a line ends; no word has that byte."""
    return text.translate(LINE_TABLE).replace(b"\n", b" \x01 ").split()


def encode(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words, 0 for those that aren't in the vocabulary."""
    return np.fromiter(map(vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))


def shingle_codes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of 62 bits for each run of ``size`` ids; runs with an id 0 get -1. Equal runs have equal hashes; what is
    found by a hash has to be compared by its ids."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    codes, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        part = ids[k : n + k]
        codes = (codes ^ part.astype(np.uint64)) * _MIX
        codes ^= codes >> np.uint64(29)
        known &= part > 0
    return np.where(known, (codes >> np.uint64(2)).astype(np.int64), -1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0], then the next."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
