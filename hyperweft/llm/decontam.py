"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

A document is contaminated by an item if some run of its words is within `rate` * (words of the item) word
edits of the item (words: runs of bytes other than ASCII marks and white space; A-Z count as a-z).

The CGK random walk (Chakraborty, Goldenberg and Koucky, 2016) reads a word, writes it, and goes on to the next one or
stays, by a random bit of the step and the word: sequences at a small edit distance fall into step again and
become sequences at a small Hamming distance. Sampling `bits` positions of such an embedding is an LSH for
Hamming distance; `walks` * `samples` tables reach the target recall. Items are embedded from each of their
words, windows of documents every `stride` words, so that windows start all along a copied item, and a stretch
without edits yields a key wherever in the item it is. Keys that read beyond the item's end are left out.

With the defaults the measured recall of random-word items of 5 to 100 words (200 a case) is at least 0.995 at the limit
of 20 % word edits, at random places, at the head, at the tail or in one block, and 1.0 for exact copies.

A hit names a window and an item, and so the place where the item would start. Places of one item that are close
together are verified at once, by the words in common, which an edit distance bounds, and then by dynamic programming
over the window with slack on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweft.llm.common import BROADCAST_BYTES, FOLD, MARKS, hashed_words, id_back, id_key, materialize, mix, slices, text_bytes

ONE = np.uint64(1)
#: Hits that are looked at together in one table, and bits of a word's place in what names a hit.
HITS, PLACE = 1 << 20, 40
#: One odd factor for each sampled position of a key.
ODD = [np.uint64(int(x) * 2 + 1) for x in np.random.default_rng(41).integers(2**60, 2**63, 16)]


@dataclass(frozen=True)
class DecontamParams:
    """index_bytes bounds the index that is broadcast; items whose tables are larger together take more passes over the documents."""

    rate: float = 0.2
    walks: int = 8
    samples: int = 6
    bits: int = 3
    stride: int = 4
    steps: int = 48
    index_bytes: int = 64 << 20
    seed: int = 17

    @property
    def words_at_once(self) -> int:
        """Words of items that an index of index_bytes holds: a key, item and place of 16 bytes, and up to 8 of a bitmap, in every table."""
        return max(1, self.index_bytes // (24 * self.walks * self.samples))


def edit_distance(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """The least number of word edits between item and any run of window's words, and where the run ends."""
    j = np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, dtype=np.int64)
    for w in item:
        new = row + 1
        np.minimum(new[1:], row[:-1] + (window != w), out=new[1:])
        row = np.minimum.accumulate(new - j) + j
    end = int(row.argmin())
    return int(row[end]), end


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the place of each text's first word (one more at the end)."""
    data, offsets = text_bytes(column)
    return hashed_words(FOLD[data], offsets, MARKS)


#: Windows of a slice that are embedded at once.
WINDOWS = 1 << 17


class Index:
    """Items and the tables of their sampled embeddings; made once, and sent as arrays."""

    def __init__(self, items: list[tuple[int, str | None]], p: DecontamParams):
        self.p = p
        self.items = []
        hashes, texts = words(pa.array([t for _, t in items], pa.string()))
        for (i, _), a, b in zip(items, texts[:-1], texts[1:], strict=True):
            h = hashes[a:b]
            if len(h):
                self.items.append((i, h))
        rng = np.random.default_rng(p.seed)
        self.seeds = rng.integers(1, 2**63, p.walks, dtype=np.uint64)
        self.passes = []
        for stride, low, high in ((1, 1, 8), (p.stride, 8, 1 << 60)):
            mine = [k for k, (_, h) in enumerate(self.items) if low <= len(h) < high]
            sizes = sorted({len(self.items[k][1]).bit_length() - 1 for k in mine})
            if sizes:
                plans = [(c, self._positions(rng, min(p.steps, max(1, 3 * (1 << c) // 2)))) for c in sizes]
                self.passes.append((stride, max(pos.max() for _, pos in plans) + 1, plans, self._tables(mine, plans)))

    @cached_property
    def bags(self) -> list[frozenset]:
        return [frozenset(h.tolist()) for _, h in self.items]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "bags"}

    def _positions(self, rng: np.random.Generator, steps: int) -> np.ndarray:
        """[walk, sample, bit]: one step of each of `bits` equal parts of the walk, from its first two thirds, as neighbouring steps often read one word."""
        k = min(self.p.bits, steps)
        edges = np.arange(k) * steps / k
        return np.floor(edges + rng.random((self.p.walks, self.p.samples, k)) * steps / k * (2 / 3)).astype(np.int64)

    def keys(self, h: np.ndarray, at: np.ndarray, steps: int, plans: list, last: dict | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(table, one key for each start in at) for all tables; h ends with words enough for any walk. last: gets the last word that each key of the table reads."""
        for w in range(self.p.walks):
            coins = mix(h ^ self.seeds[w])
            read: dict[int, list] = {}
            for c, pos in plans:
                for s in range(self.p.samples):
                    for b, j in enumerate(pos[w, s].tolist()):
                        read.setdefault(j, []).append(((c, s), ODD[b % len(ODD)]))
            keys: dict[tuple[int, int], np.ndarray] = {}
            here = at.copy()
            for j in range(steps):
                if j in read:
                    word = h[here]
                    for key, odd in read[j]:
                        keys[key] = keys[key] + word * odd if key in keys else word * odd
                        if last is not None:
                            last[(key[0] * self.p.walks + w) * self.p.samples + key[1]] = here.copy()
                here += ((coins[here] >> np.uint64(j)) & ONE).astype(np.int64)
            for (c, s), v in keys.items():
                yield (c * self.p.walks + w) * self.p.samples + s, v

    def _tables(self, mine: list[int], plans: list) -> dict:
        """table -> (bits to shift keys by, bitmap of their first bits, sorted keys, item of each, words before the start)."""
        out = {}
        for plan in plans:
            some = [k for k in mine if len(self.items[k][1]).bit_length() - 1 == plan[0]]
            sizes = np.array([len(self.items[k][1]) for k in some])
            begin = np.cumsum(sizes + 64) - sizes - 64
            padded = np.concatenate([x for k in some for x in (self.items[k][1], np.zeros(64, np.uint64))])
            item, before = np.repeat(np.array(some, dtype=np.int32), sizes), (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            at, end = np.repeat(begin, sizes) + before, np.repeat(begin + sizes, sizes)
            last: dict[int, np.ndarray] = {}
            for table, keys in self.keys(padded, at, plan[1].max() + 1, [plan], last):
                inside = np.flatnonzero(last.pop(table) < end)
                order = inside[np.argsort(keys[inside], kind="stable")]
                keys = keys[order]
                bits = max(16, (4 * len(keys)).bit_length())
                shift = np.uint64(64 - bits)
                bitmap = np.zeros(1 << bits, dtype=bool)
                bitmap[(keys >> shift).astype(np.int64)] = True
                out[table] = (shift, bitmap, keys, item[order], before[order])
        return out

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(text, item_id, first word, edits, similarity): the best run of each text and item."""
        h, texts = words(column)
        if not len(h) or not self.items:
            return []
        sizes, ends, flat = np.diff(texts), texts[1:], h.tolist()
        h = np.concatenate([h, np.zeros(64, np.uint64)])
        # a hit is an item, and the place of its first word where each document has `most` places before its own first word
        most = max(len(x) for _, x in self.items)
        found = np.zeros(0, dtype=np.int64)
        for stride, steps, plans, tables in self.passes:
            # windows of each document from its own first word on
            at = np.arange(len(h) - 64)
            inside = at - np.repeat(ends - sizes, sizes)
            every = at[inside % stride == 0]
            for k in range(0, len(every), WINDOWS):
                # the walks of these windows read no further than `steps` words
                origin = every[k]
                at = every[k : k + WINDOWS] - origin
                for table, keys in self.keys(h[origin : origin + at[-1] + 64], at, steps, plans):
                    if table not in tables:
                        continue
                    shift, bitmap, known, items, before = tables[table]
                    hit = np.flatnonzero(bitmap[(keys >> shift).astype(np.int64)])
                    low, high = np.searchsorted(known, keys[hit], "left"), np.searchsorted(known, keys[hit], "right")
                    some = high > low
                    start, low, n = at[hit[some]] + origin, low[some], (high - low)[some]
                    place = start + (np.searchsorted(ends, start, "right") + 1) * most
                    total = np.cumsum(n)
                    for a in range(0, int(total[-1]) if len(total) else 0, HITS):
                        r = np.arange(a, min(a + HITS, total[-1]))
                        row = np.searchsorted(total, r, "right")
                        y = low[row] + r - (total - n)[row]
                        found = np.union1d(found, (items[y].astype(np.int64) << PLACE) + place[row] - before[y])
        if not len(found):
            return []
        item, place = found >> PLACE, found & ((1 << PLACE) - 1)
        doc = np.searchsorted(texts[:-1] + np.arange(len(sizes)) * most, place, "right") - 1
        first = place - (doc + 1) * most
        slack = (self.p.rate * np.array([len(x) for _, x in self.items]) + 1e-9).astype(np.int64)
        apart = np.ones(len(found), dtype=bool)
        apart[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(first) > slack[item[1:]])
        heads = np.flatnonzero(apart)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(found)).tolist(), strict=True):
            d = int(doc[a])
            self._verify(h, flat, int(item[a]), int(first[a]), int(first[b - 1]), d, int(ends[d] - sizes[d]), int(ends[d]), best)
        return [(doc, self.items[k][0], first, edits, 1 - edits / len(self.items[k][1])) for (doc, k), (edits, first) in sorted(best.items())]

    def _verify(self, h: np.ndarray, flat: list[int], k: int, first: int, final: int, doc: int, begin: int, end: int, best: dict) -> None:
        """Look for item k where it starts about `first` to `final`."""
        item = self.items[k][1]
        most = int(self.p.rate * len(item) + 1e-9)
        low, high = max(begin, first - most), min(end, final + len(item) + most)
        if best.get((doc, k), (1, 0))[0] == 0:
            return
        # all but `most` of the item's different words must be somewhere in the window
        if len(self.bags[k].intersection(flat[low:high])) < len(self.bags[k]) - most:
            return
        window = h[low:high]
        edits, stop = edit_distance(item, window)
        if edits <= most and edits < best.get((doc, k), (1 << 60, 0))[0]:
            # the run's first word: the same search backwards from its end
            _, length = edit_distance(item[::-1], window[:stop][::-1])
            best[doc, k] = (edits, low + stop - length - begin)


def contaminated(docs: DataFrame, benchmark: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """(id, h, item_id, first_word, edits, similarity): a row for each doc_id, text and item that it holds.

    h: a hash of the text. Null or empty texts and items without words match nothing; equal items each match; a
    null item_id is kept as null. Documents are read once for each `words_at_once` words of items, without a shuffle; only the items of
    one pass are on the driver, which makes their index once and broadcasts it. Of places with equally few edits the first one counts.
    """
    p = params
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").distinct()
    # no fewer than the words of an item, each of which starts a row of every table
    starts = F.size(F.split("text", r"[\x00-\x7F&&[^A-Za-z0-9_]]+"))
    total = items.agg(F.sum(starts)).first()[0] or 0
    blocks = max(1, -(-total // p.words_at_once))
    narrow = docs.select(id_key().alias("id"), F.xxhash64("text").alias("h"), "text")
    out = None
    for k in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        if not some and (out is not None or k < blocks - 1):
            continue
        shared = docs.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in some], p))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in slices(batches, text=2):
                found = index.search(b.column(2))
                at = pa.array([f[0] for f in found], pa.int64())
                cols = [pa.array([f[j] for f in found], t) for j, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *cols], ["id", "h", "item_id", "first_word", "edits", "similarity"])

        part = narrow.mapInArrow(run, "id long, h long, item_id long, first_word long, edits long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def op8_decontamination(docs: DataFrame, benchmark: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """doc_id, item_id, first_word, edits, similarity: a row for each document and benchmark item that it holds."""
    return contaminated(docs, benchmark, params).select(id_back(F.col("id")).alias("doc_id"), "item_id", "first_word", "edits", "similarity")


def clean_documents(docs: DataFrame, benchmark: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """Rows of docs that hold no benchmark item, with the columns of docs."""
    bad = materialize(contaminated(docs, benchmark, params).select(F.col("id").alias("__hw_id"), F.col("h").alias("__hw_h")).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() * 24 <= BROADCAST_BYTES else bad
    return docs.withColumn("__hw_id", id_key()).withColumn("__hw_h", F.xxhash64("text")).join(bad, ["__hw_id", "__hw_h"], "left_anti").select(*docs.columns)
