"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds its letters, each permuted (rotated)
by its place, by multiplication. A text bundles (adds) the vectors of all its n-grams, a language
bundles its texts, and a text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweft.llm.common import BROADCAST_BYTES, materialize, slices, with_fields


@dataclass(frozen=True)
class LanguageParams:
    """rows_per_lang bounds (in expectation, by a hash of doc_id) the labelled rows of each language that prototypes are learned from. All languages are learned."""

    dim: int = 1024
    n: int = 3
    rows_per_lang: int = 4000
    sharpness: float = 40.0
    seed: int = 11


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class Profiler:
    """Texts to hypervectors."""

    def __init__(self, p: LanguageParams):
        self.p = p
        self.known: dict[int, int] = {}
        self.vectors = np.zeros((0, p.dim), dtype=np.int8)

    def _rows(self, letters: np.ndarray) -> np.ndarray:
        new = [c for c in letters.tolist() if c not in self.known]
        if new:
            drawn = [np.random.default_rng((self.p.seed, c)).integers(0, 2, self.p.dim, dtype=np.int8) * 2 - 1 for c in new]
            self.known.update(zip(new, range(len(self.vectors), len(self.vectors) + len(new)), strict=True))
            self.vectors = np.concatenate([self.vectors, np.array(drawn, dtype=np.int8)])
        return np.array([self.known[c] for c in letters.tolist()], dtype=np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(one vector a text, whether it has a letter)."""
        n, codes, owners, has = self.p.n, [], [], np.zeros(len(texts), dtype=bool)
        for k, t in enumerate(texts):
            if not t:
                continue
            chars = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            is_letter = _letters()[chars]
            if not is_letter.any():
                continue
            has[k] = True
            chars = np.where(is_letter, chars, 32).astype(np.uint64)
            chars = np.concatenate([[np.uint64(32)], chars, [np.uint64(32)]])
            chars = chars[(chars != 32) | np.concatenate([[True], chars[:-1] != 32])]  # one space between words
            size = max(1, len(chars) - n + 1)
            code = np.zeros(size, dtype=np.uint64)
            for j in range(n):
                code = code << np.uint64(21)
                part = chars[j : j + size]
                code[: len(part)] |= part
            codes.append(code)
            owners.append(np.full(size, k))
        out = np.zeros((len(texts), self.p.dim), dtype=np.float32)
        if codes:
            grams, inverse = np.unique(np.concatenate(codes), return_inverse=True)
            rows = np.flatnonzero(has)
            place = np.zeros(len(texts), dtype=np.int64)
            place[rows] = np.arange(len(rows))
            owner = place[np.concatenate(owners)]
            for i in range(0, len(grams), 16_384):  # bounds the memory, whatever the number of n-grams
                some = grams[i : i + 16_384]
                bound = np.ones((len(some), self.p.dim), dtype=np.int8)
                for j in range(n):
                    letters, where = np.unique((some >> np.uint64(21 * (n - 1 - j))) & np.uint64((1 << 21) - 1), return_inverse=True)
                    bound *= np.roll(self.vectors_of(letters), n - 1 - j, axis=1)[where]
                here = (inverse >= i) & (inverse < i + len(some)) if len(grams) > 16_384 else slice(None)
                counts = np.bincount(owner[here] * len(some) + inverse[here] - i, minlength=len(rows) * len(some)).reshape(len(rows), len(some))
                out[rows] += counts.astype(np.float32) @ bound.astype(np.float32)
        return out, has

    def vectors_of(self, letters: np.ndarray) -> np.ndarray:
        rows = self._rows(letters)  # may add vectors
        return self.vectors[rows]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def prototypes(labelled: DataFrame, params: LanguageParams = LanguageParams()) -> tuple[list[str], np.ndarray]:
    """Learn from labelled(doc_id, text, lang); languages in alphabetical order and their unit vectors."""
    p = params
    usable = labelled.filter("lang is not null and text is not null")
    counts = materialize(usable.groupBy("lang").count(), "langs")
    if (n := counts.count()) * p.dim * 4 > BROADCAST_BYTES:
        raise ValueError(f"{n} languages: their prototypes don't fit {BROADCAST_BYTES} bytes")
    share = F.broadcast(counts.select("lang", (F.lit(p.rows_per_lang) / F.col("count")).alias("share")))  # fewer bytes than the prototypes
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.join(share, "lang").filter(draw < F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile, sums = Profiler(p), {}
        for b in slices(batches):
            vectors, _ = profile(b.column(1).to_pylist())
            vectors = unit(vectors)
            for k, lang in enumerate(b.column(0).to_pylist()):
                sums[lang] = sums.get(lang, 0) + vectors[k].astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * p.dim, "at": np.arange(p.dim, dtype=np.int32), "value": v})

    parts = sample.mapInArrow(run, "lang string, at int, value double")
    summed = parts.groupBy("lang", "at").agg(F.sum("value").alias("value"))  # langs * dim rows
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v")).orderBy("lang").collect()
    # rounded, so that the order in which tasks are added doesn't show
    return [r["lang"] for r in rows], unit(np.array([[round(x["value"], 6) for x in r["v"]] for r in rows]).reshape(len(rows), p.dim))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], params: LanguageParams = LanguageParams()) -> DataFrame:
    """Add lang_pred and score to docs(text, ...): 'und' and 0 without a letter or without a known language.

    score: the predicted language's share in a softmax of the cosines. One pass without a shuffle.
    """
    at, p = docs.columns.index("text"), params
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, protos = shared.value
        profile, protos = Profiler(p), protos.T.astype(np.float32)
        for b in slices(batches, text=at):
            vectors, has = profile(b.column(at).to_pylist())
            if langs:
                cosines = unit(vectors) @ protos
                e = np.exp(p.sharpness * (cosines - cosines.max(1, keepdims=True)).astype(np.float64))
                best, score = cosines.argmax(1), e.max(1) / e.sum(1)
            else:
                has, best, score = np.zeros_like(has), np.zeros(len(has), int), np.zeros(len(has))
            names = [langs[k] if h else "und" for k, h in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0), pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, with_fields(docs.schema, "lang_pred string, score double"))


def op4_language_id(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, row by row where a doc_id repeats.

    A null or empty text, or one without a letter, is 'und' with score 0; so is every text if no language can be learned. Of
    languages with equal cosines the first in the order of letters is predicted. A null doc_id is not held out.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = prototypes(docs.filter(~held).select("doc_id", "text", "lang"), params)
    out = identify(docs.select("doc_id", "text"), model, params)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
