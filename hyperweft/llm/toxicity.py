"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with word ends) and itself, each hashed to a row of one
embedding table. A document is the mean of all its rows; a linear softmax over it gives the class.
Table and softmax are trained together. An unseen misspelling shares most n-grams with the known
word and so its vectors.

The mean is linear, so after training each row of the table shrinks to one number (its product with the
difference of the softmax's two weight vectors), and a document's logit is a mean of numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweft.llm.common import slices, with_fields

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityParams:
    """rows_of_0 and rows_of_1 bound the labelled sample that the classifier is fitted on (lowest hashes of doc_id)."""

    rows_of_0: int = 4000
    rows_of_1: int = 1600
    buckets: int = 1 << 18
    dim: int = 4
    shortest: int = 3
    longest: int = 5
    epochs: int = 10
    batch: int = 32
    rate: float = 1.0
    seed: int = 7
    threshold: float = 0.7


def subwords(words: list[str], p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of all words, word after word, and how many each word has."""
    text = "".join(f"<{w}>" for w in words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    ends = np.repeat(np.cumsum(lengths), lengths)
    word_of, at = np.repeat(np.arange(len(words)), lengths), np.arange(len(chars))
    parts, owners = [], []
    h = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, p.longest + 1):
        h = h[: len(chars) - n + 1] * np.uint64(1_000_003) + chars[n - 1 :]
        if n >= p.shortest:
            whole = at[: len(h)] + n <= ends[: len(h)]
            parts.append(h[whole] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
            owners.append(word_of[: len(h)][whole])
    # the word itself: a polynomial over all its characters
    power = chars * (np.uint64(0xD6E8FEB86659FD93) ** ((at - (ends - np.repeat(lengths, lengths))).astype(np.uint64) + np.uint64(1)))
    parts.append(np.add.reduceat(power, np.cumsum(lengths) - lengths) if len(words) else power)
    owners.append(np.arange(len(words)))
    rows, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    rows = rows[order]
    rows ^= rows >> np.uint64(29)
    return ((rows * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - int(p.buckets).bit_length() + 1)).astype(np.int32), np.bincount(owner, minlength=len(words))


def train(texts: list[str], labels: np.ndarray, p: ToxicityParams) -> tuple[np.ndarray, float]:
    """Fit table and softmax; gives the product of each row with the class difference, and the bias."""
    ids: dict[str, int] = {}
    docs = []
    for t in texts:
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in WORD.findall((t or "").lower())), dtype=np.int64)
        docs.append(np.unique(w, return_counts=True))
    words = list(ids)
    starts, rows, counts = [0], [], []
    for i in range(0, len(words), 50_000):
        r, c = subwords(words[i : i + 50_000], p)
        rows.append(r)
        counts.append(c)
    rows, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, counts))
    starts = np.concatenate([[0], np.cumsum(counts)])

    def gathered(w: np.ndarray) -> np.ndarray:
        """The positions in rows of all n-grams of the words w."""
        n = counts[w]
        return np.repeat(starts[w] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())

    rng = np.random.default_rng(p.seed)
    table = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    soft = np.zeros((p.dim, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    seen_t, seen_s, seen_b = np.full(p.buckets, 1e-8, np.float32), np.full((p.dim, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    soft += rng.normal(0, 1, soft.shape).astype(np.float32)
    keep = np.array([i for i, (w, _) in enumerate(docs) if len(w)], dtype=np.int64)
    onehot = np.eye(2, dtype=np.float32)
    for _ in range(p.epochs):
        rng.shuffle(keep)
        for i in range(0, len(keep), p.batch):
            picked = keep[i : i + p.batch]
            w = np.concatenate([docs[k][0] for k in picked])
            c = np.concatenate([docs[k][1] for k in picked])
            d = np.repeat(np.arange(len(picked)), [len(docs[k][0]) for k in picked])
            n = counts[w]
            weight = np.repeat((c / np.bincount(d, c * n)[d]).astype(np.float32), n)
            r, dd = rows[gathered(w)], np.repeat(d, n)
            at = np.concatenate([[0], np.cumsum(np.bincount(dd))[:-1]])
            mean = np.add.reduceat(table[r] * weight[:, None], at)
            z = mean @ soft + bias
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - onehot[labels[picked]]) / np.float32(len(picked)) * 8
            g_mean = g @ soft.T
            g_soft, g_bias = mean.T @ g, g.sum(0)
            touched, where = np.unique(r, return_inverse=True)
            g_rows = np.stack([np.bincount(where, weight * g_mean[dd, j], len(touched)) for j in range(p.dim)], 1).astype(np.float32)
            seen_t[touched] += (g_rows**2).mean(1)
            table[touched] -= p.rate * g_rows / np.sqrt(seen_t[touched])[:, None]
            seen_s += g_soft**2
            soft -= 0.1 * g_soft / np.sqrt(seen_s)
            seen_b += g_bias**2
            bias -= 0.1 * g_bias / np.sqrt(seen_b)
    trained = np.zeros(p.buckets, bool)
    trained[rows] = True
    diff = table @ (soft[:, 1] - soft[:, 0])
    return np.where(trained, diff, 0).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores texts; the sums of words are remembered, for at most `limit` words."""

    def __init__(self, weights: np.ndarray, bias: float, p: ToxicityParams, limit: int = 300_000):
        self.weights, self.bias, self.p, self.limit, self.known = weights, bias, p, limit, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = list({w for doc in words for w in doc if w not in self.known})
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list({w for doc in words for w in doc})
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            rows, counts = subwords(part, self.p)
            sums = np.add.reduceat(self.weights[rows].astype(np.float64), np.cumsum(counts) - counts)
            # one complex number holds a word's sum and its number of n-grams
            self.known.update(zip(part, (sums + 1j * counts).tolist(), strict=True))
        out = np.empty(len(words))
        for k, doc in enumerate(words):
            s = np.fromiter(map(self.known.__getitem__, doc), dtype=np.complex128, count=len(doc)).sum() if doc else 1j
            out[k] = s.real / s.imag + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(docs: DataFrame, marks: DataFrame, params: ToxicityParams = ToxicityParams()) -> tuple[np.ndarray, float]:
    """Train on docs(doc_id, text) with marks(doc_id, label): at most rows_of_0 and rows_of_1 rows of the labels, of lowest hash.

    The sample is chosen from ids alone; its texts go to one task, which trains and returns one weight per
    table row. Without rows of both labels every score is the share of label 1 (0 without rows).
    """
    p = params
    marked = marks.filter("doc_id is not null").filter(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int")).distinct()
    marked = marked.join(docs.select("doc_id"), "doc_id", "left_semi")
    sample = None
    for label, most in ((0, p.rows_of_0), (1, p.rows_of_1)):
        part = marked.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    # at most rows_of_0 + rows_of_1 ids: bounded whatever the input
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        labels = np.array([r[2] for r in rows], dtype=np.int64)
        if len(set(labels.tolist())) < 2:
            share = float(labels.mean()) if len(labels) else 0.0
            weights, bias = np.zeros(p.buckets, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        else:
            weights, bias = train([r[1] for r in rows], labels, p)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "bias": [bias]})

    row = texts.select("doc_id", "text", "label").repartition(1).mapInArrow(run, "weights binary, bias double").first()
    if row is None:
        return np.zeros(p.buckets, np.float32), float(np.log(1e-9))
    return np.frombuffer(row["weights"], dtype=np.float32), row["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], params: ToxicityParams = ToxicityParams(), name: str = "toxicity") -> DataFrame:
    """Add a column `name` (0 to 1) to docs(text, ...), over whole texts; a null or empty text gets the bias alone.

    No shuffle: one pass over the rows with a fixed-size model (4 bytes per bucket).
    """
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((model[0].tobytes(), model[1]))
    at, p = columns.index("text"), params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, bias = shared.value
        scorer = Scorer(np.frombuffer(raw, dtype=np.float32), bias, p)
        for b in slices(batches, text=at):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scorer(b.column(at).to_pylist()), pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, with_fields(docs.schema, f"{name} double"))


def held_out(name: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 3 == 1, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of labels that may be learned from."""
    return labels.filter(~held_out()).select("doc_id", F.col("toxic").alias("label"))


def op10_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; rows that repeat a doc_id are scored row by row.

    A null or empty text scores the model's bias alone. A score of exactly the threshold is predicted as 1. Of labelled rows with
    equal hashes of doc_id those with the smaller doc_id are learned from; a doc_id with both labels counts for both, and one with
    several texts by one of them. A null doc_id is not held out, and its labels aren't learned from.
    """
    model = fit(docs, learnable(labels), params)
    scored = score(docs.select("doc_id", "text"), model, params)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= params.threshold).cast("int").alias("predicted"))
