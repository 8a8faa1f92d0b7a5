"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hyperweft.plans.storage import BROADCAST_BYTES, cut, join_hot, new_path  # noqa: F401

#: A null doc_id is carried under this key inside the operators, and is null again in their results.
NULL_ID = -(2**63)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    return cut(df, tag)


def with_fields(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_back(col: Column) -> Column:
    return F.when(col != NULL_ID, col)


def broadcast_if_small(df: DataFrame, row_bytes: int, rows: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if rows * row_bytes is within limit; else df as it is, and the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, chars: int = 4 << 20, text: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `rows` rows and about `chars` bytes of the text column."""
    for batch in batches:
        ends = np.cumsum(np.asarray(batch.column(text).is_valid()) * np.nan_to_num(_lengths(batch.column(text))))
        start, n = 0, batch.num_rows
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + chars, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float)


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _S
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


#: Bytes that end a word: white space, and all ASCII but letters, digits and _.
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
MARKS = np.array([c < 128 and not (chr(c).isalnum() or c == 95) for c in range(256)])
#: Lower case for A-Z alone.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)

#: Random values of each byte at each of the first places of a word, for two independent hashes.
PLACES = 32
_TABLES = np.random.default_rng(20240229).integers(0, 2**64, (2, PLACES * 256), dtype=np.uint64)
_KEYS = np.random.default_rng(20240301).integers(0, 2**64, 2, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and each text's start (one more at the end); null is empty."""
    column = column.cast(pa.string()).fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte) of every word, and the place of each text's first word (one more at the end).

    alone: bytes that are words of their own after an ASCII letter, at the end of a word.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~ends_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    first[borders] = inside[borders]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[borders - 1] = inside[borders - 1]
    if alone is not None:
        tails = np.flatnonzero(last & alone[data])
        before = data[tails - 1] | 32
        tails = tails[(tails > 0) & (before >= 97) & (before <= 122) & ~first[tails]]
        first[tails], last[tails - 1] = True, True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets, "left")


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of every word; two families are independent.

    A hash is the scrambled sum of one random value for each byte and its place in the word, so that strings of any
    structure collide by chance alone, and no string is made.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    place = np.zeros(len(data), dtype=np.int64)
    place[start] = start
    place = np.arange(len(data)) - np.maximum.accumulate(place)
    value = _TABLES[family][(np.minimum(place, PLACES - 1) << 8) | data]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        value[far] = mix(mix(place[far].astype(np.uint64) + _KEYS[family]) + data[far])
    total = np.cumsum(value)
    return mix(total[end - 1] - total[start] + value[start])


def hashed_words(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the place of each text's first word (one more at the end)."""
    start, end, texts = word_spans(data, offsets, ends_word)
    return word_hashes(data, start, end), texts


def text_names(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits (two integers) of a cryptographic digest that name each text's sequence of words (parted by ASCII white space)."""
    raw = b"".join(hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts)
    both = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def window_names(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64 bits that name the `width` words from each of at, out of the words' hashes h.

    Names of 1, 2, 4, ... words are made of the two halves' names; a window is a row of these.
    """
    out, size, used, level = np.zeros(len(at), np.uint64), 1, 0, h
    while True:
        if width & size:
            out = mix((out + _KEYS[0]) * np.uint64(0x9E3779B97F4A7C15) + level[at + used])
            used += size
        size *= 2
        if size > width or len(level) <= size // 2:
            return mix(out)
        half = size // 2
        level = mix(mix(level[: len(level) - half] + _KEYS[1]) + level[half:])


SPACE = re.compile(r"[ \t\n\r\f\v]+")


def shingles(h: np.ndarray, texts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Of each text (texts: the place of each one's first word, and the end) the sorted distinct hashes of `width` consecutive words; a
    shorter text is one shingle, no words give none."""

    def rows(words: np.ndarray) -> np.ndarray:
        """Hashes of rows of words."""
        out = words[0].copy()
        for x in words[1:]:
            out = mix(out) + x
        return mix(out)

    n = max(0, len(h) - width + 1)
    every = rows(np.stack([h[j : j + n] for j in range(width)]))
    out = []
    for a, b in zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True):
        out.append(np.unique(every[a : b - width + 1]) if b - a >= width else rows(h[a:b][:, None]) if b > a else h[:0])
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
