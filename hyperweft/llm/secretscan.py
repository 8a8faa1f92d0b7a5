"""Secret scans with multipart credential linking.

Strong parts are found by pattern alone: assigned secrets, access identifiers and long hexadecimal
strings. Weak candidates (bare key-like strings, and endpoints) say nothing by themselves. They are
reported only where a complementary part is in scope:

    bare key       where an access identifier is, of which it may be the secret     -> linked_key
    endpoint       where a secret is, assigned or a linked key, which may open it   -> linked_endpoint

An assigned secret is no complement of a bare key, nor an access identifier alone one of an endpoint. The scope of a part is
what is within `scope` characters of it, and what is within `paragraph_scope` in its own paragraph (blank lines part these).

The join is a sorted interval join on span starts and ends (binary searches for each candidate), so its cost
is n log n in the parts of a text, and no pair is built. Of each reported candidate the nearest complement is named (of two
that are equally near the one before it), and all complements in scope are counted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hyperweft.llm.common import slices, with_fields

# The base kinds, in their order.
KINDS = ("assign", "access", "hex", "linked_key", "linked_endpoint")
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BLANK = re.compile(r"\n[ \t\r]*\n")
# Weak candidates.
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?ai:https?|s3|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s\"'<>]+")


@dataclass(frozen=True)
class SecretParams:
    scope: int = 200
    paragraph_scope: int = 1000
    assign_chars: int = 6
    access_chars: int = 20
    key_entropy: float = 3.5


def entropy(s: str) -> float:
    counts = np.bincount(np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8))
    p = counts[counts > 0] / len(s)
    return float(-(p * np.log2(p)).sum())


Span = tuple[str, int, int]


def scopes(text: str, parts: list[Span], p: SecretParams) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each part's scope."""
    starts, ends = np.array([x[1:] for x in parts], dtype=np.int64).reshape(-1, 2).T
    blank = np.array([m.span() for m in BLANK.finditer(text)], dtype=np.int64).reshape(-1, 2)
    opens, closes = np.append(0, blank[:, 1]), np.append(blank[:, 0], len(text))
    opens = opens[np.searchsorted(opens, starts, "right") - 1]
    closes = closes[np.minimum(np.searchsorted(closes, ends, "left"), len(closes) - 1)]
    low = np.minimum(starts - p.scope, np.maximum(starts - p.paragraph_scope, opens))
    return low, np.maximum(ends + p.scope, np.minimum(ends + p.paragraph_scope, closes))


def link(text: str, candidates: list[Span], parts: list[Span], p: SecretParams) -> list[tuple[Span, Span, int]]:
    """(candidate, its nearest part, number of parts) of each candidate that lies in the scope of a part; candidates overlap no part."""
    if not candidates or not parts:
        return []
    parts = sorted(parts, key=lambda x: (x[1], x[2]))
    low, high = scopes(text, parts, p)
    starts, ends = np.array([x[1:] for x in candidates], dtype=np.int64).T
    # scopes that start before a candidate's end, less those that end before its start
    n = np.searchsorted(np.sort(low), ends, "left") - np.searchsorted(np.sort(high), starts, "right")
    begins = np.array([x[1] for x in parts])
    by_end = sorted(range(len(parts)), key=lambda k: (parts[k][2], -k))
    stops = np.array([parts[k][2] for k in by_end])
    before, after = np.searchsorted(stops, starts, "right") - 1, np.searchsorted(begins, ends, "left")
    out = []
    for k in np.flatnonzero(n > 0).tolist():
        # of the parts on one side, the nearest one's scope reaches as far as any
        i, j = by_end[before[k]] if before[k] >= 0 else None, int(after[k]) if after[k] < len(parts) else None
        left = parts[i] if i is not None and high[i] > starts[k] else None
        right = parts[j] if j is not None and low[j] < ends[k] else None
        nearer = left if right is None or left is not None and starts[k] - left[2] <= right[1] - ends[k] else right
        out.append((candidates[k], nearer, int(n[k])))
    return out


def scan(text: str | None, p: SecretParams = SecretParams()) -> tuple[list[Span], list[tuple[Span, Span, int]]]:
    """All spans (kind, start, end) of a text, by start and then kind, and the links of the linked ones; code points, end exclusive."""
    if not text:
        return [], []
    assign = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= p.assign_chars]
    access = [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= p.access_chars] if "AKIA" in text else []
    found = assign + access + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    links: list[tuple[Span, Span, int]] = []
    if assign or access:
        taken_low, taken_high = np.sort([a for _, a, _ in found]), np.sort([b for _, _, b in found])

        def free(kind: str, pattern: re.Pattern) -> list[Span]:
            spans = [(kind, *m.span()) for m in pattern.finditer(text)]
            starts, ends = np.array([x[1:] for x in spans], dtype=np.int64).reshape(-1, 2).T
            alone = np.searchsorted(taken_low, ends, "left") == np.searchsorted(taken_high, starts, "right")
            return [x for x, ok in zip(spans, alone, strict=True) if ok]

        if access:
            keys = [x for x in free("linked_key", KEY) if is_key(text[x[1] : x[2]], p)]
            links += link(text, keys, access, p)
        links += link(text, free("linked_endpoint", ENDPOINT), assign + [x[0] for x in links], p)
        found += [x[0] for x in links]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found, sorted(links, key=lambda x: (x[0][1], KINDS.index(x[0][0])))


def is_key(s: str, p: SecretParams) -> bool:
    return re.search(r"\d", s) is not None and re.search("[A-Za-z]", s) is not None and entropy(s) >= p.key_entropy


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secrets(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>, links array<struct<kind, start, end, with_kind, with_start, with_end, n>>) of every
    row of docs(doc_id, text). n is the number of complements in scope.

    Null and empty texts have no spans; rows that repeat a doc_id are scanned row by row. One pass without a shuffle; a text's
    parts never leave it, so no key can be hot.
    """
    names = ["kind", "start", "end"]
    of_span = pa.struct([(c, pa.string() if "kind" in c else pa.int64()) for c in names])
    of_link = pa.struct([(c, pa.string() if "kind" in c else pa.int64()) for c in [*names, *(f"with_{c}" for c in names), "n"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [scan(t, params) for t in b.column(1).to_pylist()]
            spans = [[dict(zip(names, s, strict=True)) for s in x] for x, _ in found]
            links = [[dict(zip(of_link.names, [*a, *c, n], strict=True)) for a, c, n in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(of_span)), pa.array(links, pa.list_(of_link))], ["doc_id", "spans", "links"])

    fields = "kind: string, start: long, end: long"
    schema = with_fields(docs.select("doc_id").schema, f"spans array<struct<{fields}>>, links array<struct<{fields}, with_kind: string, with_start: long, with_end: long, n: long>>")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_secrets(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_links, links of every document.

    n_links: pairs of a reported candidate and a complement in its scope. links: each reported candidate and its nearest complement, as
    kind:start:end=kind:start:end, comma-joined. Spans of equal start are ordered by kind, as KINDS lists them; null and empty texts give
    counts of 0, the hash of the empty string, and empty strings. Rows that repeat a doc_id each give a row.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_links", "links"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for spans, links in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                spans = [(s["kind"], s["start"], s["end"]) for s in spans]
                base = [s for s in spans if s[0] in KINDS[:3]]
                pairs = ",".join("{kind}:{start}:{end}={with_kind}:{with_start}:{with_end}".format(**x) for x in links)
                out.append([*(sum(s[0] == k for s in base) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), sum(x["n"] for x in links), pairs])
            columns = zip(*out, strict=True) if out else ([] for _ in types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    schema = with_fields(docs.select("doc_id").schema, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_links long, links string")
    return secrets(docs, params).mapInArrow(digest, schema)
