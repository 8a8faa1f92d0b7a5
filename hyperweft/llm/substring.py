"""Substring dedup by recompression.

A window is 50 consecutive words of one document. A window is repeated if its words also start in a document with a
smaller doc_id; every word that a repeated window covers is removed.

1. Documents with equal word sequences are found by a cryptographic name of 128 bits of the whole sequence; all but those
   with the smallest doc_id are covered as wholes, and take no part in the rest.
2. Recompression: rounds, made in the task that holds a document, name runs of one symbol, and pairs of neighbours. A symbol's
   name is a hash of its parts, so all executors give equal parts equal names without exchanging them. In each round a bit of every
   symbol makes it a left or a right one, and each left one joins a following right one (up to `longest` words).
   With every symbol goes its context: the span of words that alone decides that it arises. A window that holds
   a symbol's context holds the symbol, wherever else the window occurs.
3. High-level symbols that occur in at least two documents are shared. A window that holds the context of a symbol that
   isn't shared can't be repeated. All other windows are candidates: none is lost.
4. Candidates are verified globally by 128-bit names of their 50 words, made of two independent hashes of every word, and
   give the smallest doc_id of each. At 1e13 windows a chance collision has a probability of about 1e-13.

Null texts have no words. A null doc_id is smaller than any other. Rows that repeat a doc_id are judged row by row
and never against each other. Groupings combine before their shuffles; windows of many rows are
joined by a bounded broadcast, and other joins are split by AQE.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweft.llm.common import BROADCAST_BYTES, SPACES, hashed_words, id_back, id_key, join_hot, materialize, mix, slices, text_bytes, text_names, window_names, word_hashes, word_spans
from hyperweft.llm.exactdedup import BUCKET_ROWS, BinaryFuse8


@dataclass(frozen=True)
class SubstringParams:
    window: int = 50
    rounds: int = 6
    run_rounds: tuple[int, ...] = (0, 3)
    longest: int = 16
    shortest: int = 3
    sample: int = 1
    seed: int = 23


@dataclass
class Symbols:
    """Symbols in order: name, words start to end, context low to high, and whether each begins or ends a document."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    opens: np.ndarray
    closes: np.ndarray

    def take(self, heads: np.ndarray, tails: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Symbols:
        return Symbols(name, self.start[heads], self.end[tails], low, high, self.opens[heads], self.closes[tails])


def name_runs(s: Symbols, p: SubstringParams) -> Symbols:
    """Name runs of one symbol of at most `longest` words. Where a run ends depends on both neighbours of the run."""
    n = len(s.name)
    begins = s.opens.copy()
    begins[1:] |= s.name[1:] != s.name[:-1]
    head = np.flatnonzero(begins)
    count = np.diff(np.append(head, n))
    tail = head + count - 1
    before, after = _outer(s)
    low = np.minimum(before[head], np.minimum.reduceat(s.low, head))
    high = np.maximum(after[tail], np.maximum.reduceat(s.high, head))
    long = (s.end[tail] - s.start[head] > p.longest) & (count > 1)
    if long.any():
        # the symbols of a run that is too long stay alone, with the context of the whole run
        alone = np.repeat(long, count)
        low, high = np.repeat(low, count), np.repeat(high, count)
        keep = begins | alone
        run_count = np.where(alone, 1, np.repeat(count, count))
        head = np.flatnonzero(keep)
        low, high, count = low[head], high[head], run_count[head]
        tail = head + count - 1
    name = np.where(count > 1, mix(s.name[head] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) + count.astype(np.uint64), s.name[head])
    return s.take(head, tail, name, low, high)


def _outer(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """The context of the neighbour before and after; at a document's end, beyond it, which no window holds."""
    before, after = s.low.copy(), s.high.copy()
    before[1:] = s.low[:-1]
    after[:-1] = s.high[1:]
    return np.where(s.opens, s.start - 1, before), np.where(s.closes, s.end + 1, after)


def name_pairs(s: Symbols, r: int, p: SubstringParams) -> Symbols:
    """Join each left symbol with a following right one."""
    left = (mix(s.name ^ np.uint64(p.seed * 1000 + r)) >> np.uint64(63)).astype(bool)
    joins = np.zeros(len(left), dtype=bool)
    joins[:-1] = left[:-1] & ~left[1:] & ~s.closes[:-1] & (s.end[1:] - s.start[:-1] <= p.longest)
    second = np.zeros(len(left), dtype=bool)
    second[1:] = joins[:-1]
    before, after = _outer(s)
    # a left symbol's fate depends on the one after it, a right one's on the one before
    low, high = np.where(left, s.low, np.minimum(s.low, before)), np.where(left, np.maximum(s.high, after), s.high)
    head = np.flatnonzero(~second)
    paired = joins[head]
    tail = head + paired
    name = s.name[head].copy()
    a, b = s.name[head[paired]], s.name[tail[paired]]
    name[paired] = mix(mix(a) * np.uint64(3) + b)
    low, high = low[head], high[head]
    low[paired] = np.minimum(s.low[head[paired]], s.low[tail[paired]])
    high[paired] = np.maximum(s.high[head[paired]], s.high[tail[paired]])
    return s.take(head, tail, name, low, high)


def recompress(h: np.ndarray, texts: np.ndarray, p: SubstringParams) -> Symbols:
    """Symbols of texts (word hashes, and each text's first word and the end), after all rounds; only those that are kept for matching."""
    n = len(h)
    at = np.arange(n)
    opens, closes = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    full = texts[1:] > texts[:-1]
    opens[texts[:-1][full]] = True
    closes[texts[1:][full] - 1] = True
    s = Symbols(h, at, at + 1, at, at + 1, opens, closes)
    if not n:
        return s
    for r in range(p.rounds):
        if r in p.run_rounds:
            s = name_runs(s, p)
        s = name_pairs(s, r, p)
    kept = (s.end - s.start >= p.shortest) & (s.high - s.low <= p.window) & (mix(s.name) % np.uint64(p.sample) == 0)
    return Symbols(*(x[kept] for x in (s.name, s.start, s.end, s.low, s.high, s.opens, s.closes)))


def candidates(s: Symbols, shared: np.ndarray, texts: np.ndarray, n: int, p: SubstringParams) -> np.ndarray:
    """First words of the windows that don't hold the context of a symbol that isn't shared."""
    w = p.window
    edge = np.zeros(n + 2, dtype=np.int32)
    alone = ~shared
    np.add.at(edge, np.maximum(s.high[alone] - w, 0), 1)
    np.add.at(edge, s.low[alone] + 1, -1)
    open_ = np.cumsum(edge[:n]) == 0
    ends = np.repeat(texts[1:], np.diff(texts))
    return np.flatnonzero(open_ & (np.arange(n) + w <= ends))


def _hashed(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(b.column(column))
    return hashed_words(data, offsets, SPACES)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(id_key().alias("id"), F.xxhash64("text").alias("h"), "text")


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def fuse_set(keys: DataFrame, count: int) -> list[bytes]:
    """Binary-fuse filters of keys(sym), by pmod(sym, number of filters)."""
    buckets = max(1, -(-count // BUCKET_ROWS))

    def build(key: tuple, t: pa.Table) -> pa.Table:
        raw = BinaryFuse8.build(t.column("sym").to_numpy().view(np.uint64)).to_bytes()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([raw], pa.binary())})

    rows = keys.select("sym", F.pmod("sym", F.lit(buckets)).cast("long").alias("bucket")).groupBy("bucket").applyInArrow(build, "bucket long, filter binary").collect()
    out = [b""] * buckets
    for r in rows:
        out[r["bucket"]] = bytes(r["filter"])
    return out


def in_fuse_set(filters: list[BinaryFuse8 | None], names: np.ndarray) -> np.ndarray:
    out = np.zeros(len(names), dtype=bool)
    bucket = np.mod(names.view(np.int64), len(filters))
    for k, f in enumerate(filters):
        mine = np.flatnonzero(bucket == k)
        if f is not None and len(mine):
            out[mine] = f.contains(names[mine])
    return out


def removals(docs: DataFrame, params: SubstringParams = SubstringParams()) -> DataFrame:
    """(id, h, spans): for each row with removed words, their spans as pairs of 32-bit integers (first word, end)."""
    p = params
    keyed = _keyed(docs)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text=2):
            raw = [x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()]
            n = np.array([len(x.split()) for x in raw], dtype=np.int64)
            names = text_names(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[0]), pa.array(names[1]), pa.array(n)], ["id", "h", "root", "root2", "n"]).filter(pa.array(n >= p.window))

    named = materialize(keyed.mapInArrow(roots, "id long, h long, root long, root2 long, n long"), "roots")
    first = named.groupBy("root", "root2").agg(F.min("id").alias("m"), F.max("id").alias("x"), F.count("*").alias("copies")).filter("m < x").select("root", "root2", "m", "copies")
    whole = materialize(join_hot(named, materialize(first, "copies"), ["root", "root2"], "copies").filter("id > m").select("id", "h", "n").distinct(), "wholes")
    short_or_copy = _small(whole.select("id", "h"), 32)
    reps = keyed.join(short_or_copy, ["id", "h"], "left_anti").select("id", "h", "text")

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text=2):
            h, texts = _hashed(b, 2)
            s = recompress(h, texts, p)
            owner = np.searchsorted(texts, s.start, "right") - 1
            long = (np.diff(texts) >= p.window)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(s.name[long].view(np.int64)), b.column(0).take(pa.array(owner[long]))], ["sym", "id"])

    shared = reps.mapInArrow(symbols, "sym long, id long").groupBy("sym").agg(F.min("id").alias("m"), F.max("id").alias("x"), F.count("*").alias("n")).filter("m < x").select("sym", "n")
    shared = materialize(shared, "shared")
    count = shared.count()
    if count * 9 // 8 <= BROADCAST_BYTES:
        filters = docs.sparkSession.sparkContext.broadcast(fuse_set(shared, count))
        given = reps.withColumn("syms", F.lit(None).cast("array<long>"))
    else:
        filters = None

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text=2):
                h, texts = _hashed(b, 2)
                s = recompress(h, texts, p)
                owner = pa.array(np.searchsorted(texts, s.start, "right") - 1)
                yield pa.RecordBatch.from_arrays([pa.array(s.name.view(np.int64)), b.column(0).take(owner), b.column(1).take(owner)], ["sym", "id", "h"])

        lists = join_hot(reps.mapInArrow(placed, "sym long, id long, h long"), shared, ["sym"], "n").groupBy("id", "h").agg(F.collect_set("sym").alias("syms"))
        # a text without a shared symbol has candidates too: windows that hold no kept symbol's context
        given = reps.join(lists, ["id", "h"], "left")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if filters is None else [BinaryFuse8.from_bytes(x) if x else None for x in filters.value]
        for b in slices(batches, text=2):
            data, offsets = text_bytes(b.column(2))
            first, last, texts = word_spans(data, offsets, SPACES)
            h = word_hashes(data, first, last)
            s = recompress(h, texts, p)
            if known is not None:
                hit = in_fuse_set(known, s.name)
            else:
                owner = np.searchsorted(texts, s.start, "right") - 1
                sets = [frozenset(x or ()) for x in b.column(3).to_pylist()]
                hit = np.array([int(v) in sets[o] for v, o in zip(s.name.view(np.int64), owner, strict=True)], dtype=bool)
            at = candidates(s, hit, texts, len(h), p)
            w1, w2 = (window_names(x, at, p.window).view(np.int64) for x in (h, word_hashes(data, first, last, 1)))
            owner = np.searchsorted(texts, at, "right") - 1
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), b.column(0).take(rows), b.column(1).take(rows), pa.array((at - texts[owner]).astype(np.int32))], ["w1", "w2", "id", "h", "at"])

    found = materialize(given.mapInArrow(windows, "w1 long, w2 long, id long, h long, at int"), "windows")
    least = found.groupBy("w1", "w2").agg(F.min("id").alias("m"), F.max("id").alias("x"), F.count("*").alias("n")).filter("m < x").select("w1", "w2", "m", "n")
    covered = join_hot(found, materialize(least, "least"), ["w1", "w2"], "n").filter("id > m").select("id", "h", "at")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(2):
                at = np.unique(x.values.to_numpy())
                cut = np.flatnonzero(np.diff(at) > p.window)
                out.append(np.stack([at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + p.window], 1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["id", "h", "spans"])

    # a row's list is no longer than its text
    listed = covered.groupBy("id", "h").agg(F.collect_list("at").alias("at")).mapInArrow(spans, "id long, h long, spans binary")

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.array([0, n], dtype="<i4").tobytes() for n in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["id", "h", "spans"])

    return listed.unionByName(whole.mapInArrow(wholes, "id long, h long, spans binary"))


def op7_substring_dedup(docs: DataFrame, params: SubstringParams = SubstringParams()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs(doc_id, text)."""
    removed = materialize(removals(docs, params), "removals")
    joined = _keyed(docs).join(_small(removed, 96), ["id", "h"], "left").select("id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total, gone, names = [], [], []
            for raw, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = raw.split() if raw else []  # bytes.split() splits at the six ASCII spaces alone
                total.append(len(words))
                if spans:
                    for a, e in np.frombuffer(spans, dtype="<i4").reshape(-1, 2)[::-1].tolist():
                        del words[a:e]
                gone.append(total[-1] - len(words))
                names.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(names, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    out = joined.mapInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string")
    return out.select(id_back(F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
placed AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
win AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 49), ' ') AS k FROM placed WHERE p + 49 <= len(ws)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
rep AS (SELECT doc_id, p FROM win JOIN least USING (k) WHERE m < doc_id),
cov AS (SELECT DISTINCT doc_id, p + o AS p FROM rep, range(0, 50) r(o)),
kept AS (SELECT a.doc_id, string_agg(a.ws[a.p], ' ' ORDER BY a.p) AS t, count(*) AS n FROM placed a LEFT JOIN cov c ON a.doc_id = c.doc_id AND a.p = c.p WHERE c.p IS NULL GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
