"""Exact dedup against an immutable snapshot, screened by static binary-fuse filters.

Texts are equal when identical after lower-casing A-Z only. Each text is named by the SHA-256 of its
normalised bytes, and the digest's first bits deal it to a bucket.

1. The snapshot's digests are grouped; each bucket gets one static binary-fuse filter (8-bit
   fingerprints, three probes, about 9 bits a digest). Snapshots never change, so neither do filters.
2. The new batch's digests are grouped among themselves, which finds duplicates inside the batch,
   and screened by the filter of their bucket. A negative is certainly new.
3. Positives meet the snapshot's digests of their bucket (an exact join, which drops false positives).
4. The texts of all digests that occur twice are compared byte by byte: they are grouped by digest
   and text, so that even a digest collision can't join different texts.

Hot groups: every grouping combines before its shuffle, so a text with a third of all rows is one row
for each task. Joins that bring a class back to its rows are split by AQE; only classes of two or
more rows take part in them.

Null text counts as empty. A null doc_id is a document of its own with the smallest id. Rows that
repeat a doc_id with an equal text are one document and share its flags; a doc_id with
different texts is judged text by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweft.llm.common import BROADCAST_BYTES, NULL_ID, id_back, id_key, materialize, mix, slices

#: Digests of a bucket, as a target; hash buckets of distinct digests are even.
BUCKET_ROWS = 200_000
SLOTS = 3


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


class BinaryFuse8:
    """A static binary-fuse filter of 64-bit keys: no false negatives, about 1/256 false positives."""

    HEADER = np.dtype([("seed", "<u8"), ("segment", "<u4"), ("segments", "<u4")])

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Each key's three cells, in three neighbouring segments, and its fingerprint."""
        h = mix(keys + np.uint64(seed))
        first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        g = mix(h)
        cells = [(first + np.uint64(j)) * np.uint64(segment) + ((g >> np.uint64(20 * j)) & np.uint64(segment - 1)) for j in range(SLOTS)]
        return np.stack(cells).astype(np.int64), (h ^ (h >> np.uint64(8))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        keys = np.unique(np.asarray(keys, dtype=np.uint64))
        n = len(keys)
        size = max(4, int(n * (1.125 if n > 50_000 else 1.3)) + 32)
        segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        seed = 0
        while True:
            segments = max(1, -(-size // segment))
            cells, prints = cls._slots(keys, seed, segment, segments)
            order = cls._peel(cells, (segments + SLOTS - 1) * segment)
            if order is not None:
                break
            seed += 1
            size += size // 16 if seed % 4 == 0 else 0
        table = np.zeros((segments + SLOTS - 1) * segment, dtype=np.uint8)
        # cells that a round frees are disjoint, so that a round is filled at once
        for who, where in reversed(order):
            others = table[cells[0, who]] ^ table[cells[1, who]] ^ table[cells[2, who]]
            table[where] = prints[who] ^ others ^ table[where]
        return cls(seed, segment, segments, table)

    @staticmethod
    def _peel(cells: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the cell that each owns alone at that time); None if some keys can't be peeled."""
        left = np.ones(cells.shape[1], dtype=bool)
        count = np.bincount(cells.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)
        index = np.tile(np.arange(cells.shape[1]), SLOTS)
        np.bitwise_xor.at(owner, cells.ravel(), index)
        rounds, gone = [], 0
        while gone < cells.shape[1]:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                return None
            who, pick = np.unique(owner[alone], return_index=True)
            rounds.append((who, alone[pick]))
            left[who] = False
            gone += len(who)
            flat = cells[:, who].ravel()
            np.subtract.at(count, flat, 1)
            np.bitwise_xor.at(owner, flat, np.tile(who, SLOTS))
        return rounds

    def contains(self, keys: np.ndarray) -> np.ndarray:
        cells, prints = self._slots(np.asarray(keys, dtype=np.uint64), self.seed, self.segment, self.segments)
        return (self.prints[cells[0]] ^ self.prints[cells[1]] ^ self.prints[cells[2]]) == prints

    def to_bytes(self) -> bytes:
        return np.array([(self.seed, self.segment, self.segments)], dtype=self.HEADER).tobytes() + self.prints.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BinaryFuse8:
        head = np.frombuffer(raw[: cls.HEADER.itemsize], dtype=cls.HEADER)[0]
        return cls(int(head["seed"]), int(head["segment"]), int(head["segments"]), np.frombuffer(raw[cls.HEADER.itemsize :], dtype=np.uint8))


def _key64(digests: pa.Array) -> np.ndarray:
    """The last 8 bytes of each digest (the first ones choose the bucket)."""
    return np.array([int.from_bytes(x[-8:], "big") for x in digests.to_pylist()], dtype=np.uint64)


def digested(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256, keep_text: bool = False) -> DataFrame:
    """(id, digest, digest of the text in hex[, norm]) of docs(doc_id, text): one pass, bytes.lower() folds A-Z alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            low = [x.lower() if x else b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            out = [b.column(0), pa.array([digest(x) for x in low], pa.binary())]
            if digest is not sha256:
                out.append(pa.array([sha256(x) for x in low], pa.binary()))
            else:
                out.append(out[1])
            if keep_text:
                out.append(pa.array(low, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["id", "digest", "sha", *(["norm"] if keep_text else [])]
    return docs.select(id_key().alias("id"), "text").mapInArrow(run, "id long, digest binary, sha binary" + ", norm binary" * keep_text)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def snapshot_index(keys: DataFrame) -> DataFrame:
    """(digest, keep, n) of keys(id, digest): the index of an immutable snapshot."""
    return keys.groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("n"))


def fuse_filters(index: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter) over index(digest); a bucket holds about BUCKET_ROWS digests."""

    def build(keys: tuple, t: pa.Table) -> pa.Table:
        raw = BinaryFuse8.build(_key64(t.column("digest").combine_chunks())).to_bytes()
        return pa.table({"bucket": pa.array([keys[0].as_py()], pa.int32()), "filter": pa.array([raw], pa.binary())})

    return index.select("digest", _bucket(buckets).alias("bucket")).groupBy("bucket").applyInArrow(build, "bucket int, filter binary")


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Rows of batch(digest, keep, n) that the filter of their bucket doesn't rule out."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.drop_columns(["bucket"])
        if not left.num_rows or not right.num_rows:
            return left.slice(0, 0)
        fuse = BinaryFuse8.from_bytes(right.column("filter")[0].as_py())
        return left.filter(pa.array(fuse.contains(_key64(left.column("digest").combine_chunks()))))

    return batch.withColumn("bucket", _bucket(buckets)).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, batch.schema)


def classes(keys: DataFrame, is_new: str = "is_new", rows: int | None = None) -> DataFrame:
    """(digest, keep, n) of the digests that occur at least twice in keys(id, digest, is_new)."""
    buckets = max(1, -(-(rows if rows is not None else keys.count()) // BUCKET_ROWS))
    index = materialize(snapshot_index(keys.filter(~F.col(is_new))), "snapshot")
    batch = materialize(snapshot_index(keys.filter(is_new)), "batch")
    positives = screen(batch, fuse_filters(index, buckets), buckets)
    both = positives.join(index.select("digest", F.col("keep").alias("old_keep"), F.col("n").alias("old_n")), "digest")
    both = materialize(both.select("digest", F.greatest("keep", "old_keep").alias("keep"), (F.col("n") + F.col("old_n")).alias("n")), "matches")
    alone = index.filter("n > 1").unionByName(batch.filter("n > 1")).join(both, "digest", "left_anti")
    return both.unionByName(alone)


def dedup(docs: DataFrame, is_new, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row per row of docs(doc_id, text): id, keep, n, sha.

    is_new: a Column over `id` that tells the incoming batch from the snapshot.
    """
    keys = materialize(digested(docs, digest).withColumn("is_new", is_new), "digests")
    found = materialize(classes(keys), "classes")
    repeated = found.count()
    # byte checks: only texts of digests that occur twice travel, one of each for a task
    texts = digested(docs, digest, keep_text=True)
    suspects = _having(texts, found, repeated)
    checked = materialize(suspects.groupBy("digest", "norm").agg(F.max("id").alias("keep"), F.count("*").alias("n")).select("digest", F.sha2("norm", 256).alias("of"), "keep", "n"), "checked")
    # a digest of several texts (a collision) is told apart by the SHA-256 of the text
    checked = checked.select("digest", F.unhex("of").alias("sha"), "keep", "n").filter("n > 1")
    out = keys.join(checked, ["digest", "sha"], "left")
    return out.select("id", F.coalesce("keep", "id").alias("keep"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.lower(F.hex("sha")).alias("sha"))


def _having(texts: DataFrame, found: DataFrame, count: int) -> DataFrame:
    """Rows of texts whose digest is in found. Where a filter of the digests is within the broadcast bound, it keeps most other texts from the shuffle."""
    if 2 * count <= BROADCAST_BYTES and count <= 4_000_000:
        spark = texts.sparkSession
        keys = found.select(F.conv(F.substring(F.hex("digest"), -16, 16), 16, -10).cast("long").alias("k")).toArrow().column("k")
        raw = spark.sparkContext.broadcast(BinaryFuse8.build(keys.to_numpy().astype(np.uint64)).to_bytes())
        schema = texts.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fuse = BinaryFuse8.from_bytes(raw.value)
            for b in batches:
                yield b.filter(pa.array(fuse.contains(_key64(b.column(1)))))

        texts = texts.mapInArrow(run, schema) if count else texts.limit(0)
    return texts.join(found.select("digest"), "digest", "left_semi")


def op9_exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The upper half of the range of doc_ids is the incoming batch, the lower half the snapshot.
    """
    low, high = docs.select(F.min("doc_id"), F.max("doc_id")).first()
    middle = NULL_ID if low is None else (low + high) // 2
    out = dedup(docs, F.col("id") > F.lit(middle))
    return out.select(id_back(F.col("id")).alias("doc_id"), id_back(F.col("keep")).alias("keep_id"), F.col("n").alias("group_size"), (F.col("id") == F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
