"""Token-ID output: fixed-width bit-packed shards with block offsets.

A shard is one self-contained binary image:

    magic 'HWTK', version u16, width u16, vocabulary u32, block ids u32, documents u64, ids u64, blocks u64
    block offsets u64 [blocks + 1]     in bytes, from the start of the payload
    doc_ids i64 [documents]
    document starts u64 [documents + 1] in ids, from the start of the shard
    payload: every id in the fewest bits that the vocabulary needs, blocks of BLOCK ids, each block on whole 64-bit words

Shards are stored as the binary column of a Parquet table, so that they can be written by Spark's commit
protocol to any store that Spark writes (a lost executor's task is simply run again). `Shard` reads an
image: any range of ids is unpacked from its own blocks alone, by numpy.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweft.llm.common import SPACES, id_back, id_key, new_path, slices, text_bytes, word_hashes, word_spans

HEAD = np.dtype([("magic", "S4"), ("version", "<u2"), ("width", "<u2"), ("vocab", "<u4"), ("block", "<u4"), ("docs", "<u8"), ("ids", "<u8"), ("blocks", "<u8")])
BLOCK = 4096
LANES = 64


def bits(vocab: int) -> int:
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """64 ids fill `width` 64-bit words; lane j of every group is shifted into place at once."""
    groups = -(-len(ids) // LANES)
    lanes = np.zeros((groups, LANES), dtype=np.uint64)
    lanes.ravel()[: len(ids)] = ids
    if width in (8, 16, 32):
        return lanes.astype(f"<u{width // 8}").tobytes()
    words = np.zeros((groups, width), dtype=np.uint64)
    for j in range(LANES):
        word, shift = divmod(j * width, 64)
        words[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{width // 8}", count=n).astype(np.uint32)
    words = np.frombuffer(raw, dtype="<u8").reshape(-1, width)
    lanes = np.empty((len(words), LANES), dtype=np.uint64)
    for j in range(LANES):
        word, shift = divmod(j * width, 64)
        lanes[:, j] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            lanes[:, j] |= words[:, word + 1] << np.uint64(64 - shift)
    return (lanes & np.uint64((1 << width) - 1)).ravel()[:n].astype(np.uint32)


def shard_image(doc_ids: list[int], docs: list[np.ndarray], vocab: int) -> bytes:
    width, ids = bits(vocab), np.concatenate(docs)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype("<u8")
    blocks = [pack(ids[i : i + BLOCK], width) for i in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = np.array([(b"HWTK", 1, width, vocab, BLOCK, len(docs), len(ids), len(blocks))], dtype=HEAD)
    return b"".join([head.tobytes(), offsets.tobytes(), np.array(doc_ids, dtype="<i8").tobytes(), starts.tobytes(), *blocks])


class Shard:
    """Random access to an image (bytes, or a memory map)."""

    def __init__(self, raw):
        raw = memoryview(raw)
        head = np.frombuffer(raw[: HEAD.itemsize], dtype=HEAD)[0]
        if head["magic"] != b"HWTK":
            raise ValueError("not a token shard")
        self.width, self.vocab, self.block = int(head["width"]), int(head["vocab"]), int(head["block"])
        n, blocks, at = int(head["docs"]), int(head["blocks"]), HEAD.itemsize
        self.ids = int(head["ids"])
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, at).astype(np.int64)
        at += 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(raw, "<i8", n, at)
        at += 8 * n
        self.starts = np.frombuffer(raw, "<u8", n + 1, at).astype(np.int64)
        self.payload = raw[at + 8 * (n + 1) :]

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        raw = bytes(self.payload[self.offsets[first] : self.offsets[last + 1]])
        # whole blocks but for the last one of a shard, so that they unpack as one run
        return unpack(raw, min(self.ids, (last + 1) * self.block) - first * self.block, self.width)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.range(self.starts[k], self.starts[k + 1])


#: A character between words that are encoded together, and how many are.
MARK = "\x01"
BUNDLE = 1000
#: Marks that the tokenizer always parts from a letter before and white space after them.
ALONE = np.zeros(256, dtype=bool)
ALONE[[ord(","), ord(".")]] = True

#: Steps before the model for which `Pieces` cuts words by itself.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: What bytes of a plain word are: letters (a-z, and C3 with the second bytes of small Latin letters), digits, other ASCII signs. Words
#: with other bytes (0) aren't plain, nor are those with ' or <, which may begin a contraction or a special token.
LETTER, DIGIT, SIGN = 1, 2, 3
KIND = np.zeros(256, dtype=np.uint8)
KIND[33:127] = SIGN
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[ord("A") : ord("Z") + 1] = 0
KIND[[*range(ord("a"), ord("z") + 1), 0xC3, *range(0x9F, 0xC0)]] = LETTER
KIND[[ord("'"), ord("<"), 0xB7]] = 0
#: The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from 256 on.
SHOWN = np.zeros(256, dtype="<u4")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN[_PRINTABLE] = _PRINTABLE
_HIDDEN = sorted(set(range(256)) - set(_PRINTABLE))
SHOWN[_HIDDEN] = np.arange(256, 256 + len(_HIDDEN))


class Pieces:
    """Plain words to ids: they are cut as the tokenizer would cut them, and its own model encodes the pieces.

    A plain word is the same after normalizing, so the model is given its pieces with a space between them, without the
    normalizer and the regular expression, which take most of the time. A piece's last id is one with the model's suffix.
    """

    def __init__(self, tokenizer, suffix: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer(tokenizer.model)
        self.tokenizer.pre_tokenizer = CharDelimiterSplit(" ")
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocab.items() if word.endswith(suffix)]] = True

    @classmethod
    def of(cls, tokenizer) -> Pieces | None:
        """None for tokenizers with other steps before the model, or whose model doesn't end every piece by its suffix."""
        made = json.loads(tokenizer.to_str())
        model, suffix = made["model"], made["model"].get("end_of_word_suffix") or ""
        steps = made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
        # plain words have no <, so that they hold no special token, and their ids' strings have it in the suffix alone
        if not steps or made["truncation"] or made["padding"] or "<" not in suffix or any("<" not in x["content"] for x in made["added_tokens"]):
            return None
        if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"]:
            return None
        shown = list(map(chr, SHOWN.tolist()))
        return cls(tokenizer, suffix) if all(c in model["vocab"] and c + suffix in model["vocab"] for c in shown) else None

    def __call__(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has) of plain words that lie in data one after the other, in runs of `size` bytes."""
        kind, start = KIND[data], np.cumsum(size) - size
        begins = kind == DIGIT
        begins[1:] |= kind[1:] != kind[:-1]
        begins[start] = True
        order = np.cumsum(begins)
        shown = np.full(len(data) + order[-1], ord(" "), dtype="<u4")
        shown[np.arange(len(data)) + order] = SHOWN[data]
        text = shown.tobytes().decode("utf-32-le")
        at = np.flatnonzero(begins)[::BUNDLE]
        cuts = [*(at + order[at] - 1).tolist(), len(text)]
        found = self.tokenizer.encode_batch_fast([text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in found])
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != order[-1]:
            raise RuntimeError("the model does not end every piece by its suffix")
        return ids, np.diff(ends[order[start + size - 1] - 1] + 1, prepend=0)


class Encoder:
    """Texts to ids, by encoding each distinct word once; for tokenizers of this kind (see WholeEncoder for others).

    The tokenizer drops white space, never joins across it, and lower-cases. So texts are cut at white space (and
    before a comma or full stop that ends a word), and A-Z are folded where that can't change what the tokenizer
    composes or takes for a special token. A table of 64-bit hashes, with two places for each, remembers the ids and the bytes
    of up to 2**bits words; pools of ids and bytes start anew at `pool` of them, which bounds the memory. The bytes of every word are
    compared with those of the word whose ids it gets: hashes choose what is compared and decide nothing.
    """

    def __init__(self, definition: str, end: int | None, bits: int = 20, pool: int = 8 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.whole = WholeEncoder(definition, end)
        self.end = np.array([] if end is None else [end], dtype=np.uint32)
        alone = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = alone[0] if len(alone) == 1 else None
        self.pieces = Pieces.of(self.tokenizer)
        self.shift, self.mask, self.limit = np.uint64(64 - bits), np.uint64((1 << bits) - 1), pool
        self._reset()

    def _reset(self) -> None:
        size = 1 << (64 - int(self.shift))
        self.keys, self.start, self.count, self.at, self.length = np.zeros(size, np.uint64), *(np.zeros(size, np.uint32) for _ in range(4))
        # the end id is at the front
        self.pool, self.used = np.zeros(1 << 16, np.uint32), len(self.end)
        self.pool[: self.used] = self.end
        self.raw, self.raw_used = np.zeros(1 << 16, np.uint8), 0

    def _encode(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids start in the pool, and how many there are. The words lie in data one after the other, in runs of `size` bytes."""
        start, count = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        begin = np.cumsum(size) - size
        plain = np.logical_and.reduceat(KIND[data] > 0, begin) if self.pieces else np.zeros(len(size), dtype=bool)
        some, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        if len(some):
            ids, count[some] = self.pieces(data[np.repeat(plain, size)], size[some])
            start[some] = self._pooled(ids) + np.cumsum(count[some]) - count[some]
        if len(rest):
            raw = data.tobytes()
            ids, count[rest] = self._bundled([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(begin[rest].tolist(), (begin + size)[rest].tolist(), strict=True)])
            start[rest] = self._pooled(ids) + np.cumsum(count[rest]) - count[rest]
        return start, count

    def _pooled(self, ids: np.ndarray) -> int:
        """Where ids start in the pool, once they are at its end."""
        start, self.used = self.used, self.used + len(ids)
        self.pool = _grown(self.pool, self.used)
        self.pool[start : self.used] = ids
        return start

    def _bundled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has).

        Words are encoded BUNDLE at a time as one text, with a mark between them that is a token of its own between spaces; bundles
        in which a word holds the mark are encoded word by word.
        """
        bundles = [words[i : i + BUNDLE] for i in range(0, len(words), BUNDLE)]
        odd = [self.mark is None or any(MARK in w for w in b) for b in bundles]
        plain = [b for b, x in zip(bundles, odd, strict=True) if not x]
        encoded = iter(self.tokenizer.encode_batch_fast([f" {MARK} ".join(b) for b in plain], add_special_tokens=False))
        parts = []
        for b, x in zip(bundles, odd, strict=True):
            if x:
                found = [e.ids for e in self.tokenizer.encode_batch_fast(b, add_special_tokens=False)]
                parts.append((np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))))
            else:
                ids = np.array(next(encoded).ids, dtype=np.uint32)
                marks = np.flatnonzero(ids == self.mark)
                parts.append((np.delete(ids, marks), np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1))
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def _holds(self, slot: np.ndarray, h: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Whether the table has each word in its slot, by hash, length and bytes. The words lie in data one after the other."""
        at = np.repeat(self.at[slot] - (np.cumsum(size) - size), size)
        at += np.arange(len(data))
        return (self.keys[slot] == h) & (self.length[slot] == size) & _equal_runs(data, self.raw, at, size)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids start and one more)."""
        if max(self.used, self.raw_used) > self.limit:
            self._reset()
        data, offsets = text_bytes(column)
        data = _folded(data)
        first, last, texts = word_spans(data, offsets, SPACES, ALONE)
        h, size = word_hashes(data, first, last), last - first
        slot = (h >> self.shift).astype(np.int64)
        # what isn't white space are the words' bytes, one word after the other
        rest = np.flatnonzero(~self._holds(slot, h, size, data[~SPACES[data]]))
        second = (h[rest] & self.mask).astype(np.int64)
        found = self._holds(second, h[rest], size[rest], data[_spread(first[rest], size[rest])])
        slot[rest[found]] = second[found]
        start, count = self.start[slot].astype(np.int64), self.count[slot].astype(np.int64)
        new = rest[~found]
        if len(new):
            words, where, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[where]
            mine, one = _spread(first[new], size[new]), at[inverse]
            if not ((size[one] == size[new]).all() and _equal_runs(data[mine], data, _spread(first[one], size[new]), size[new]).all()):
                return self.whole(column)  # two words of one hash in these texts
            length, to, second = size[at], slot[at], (words & self.mask).astype(np.int64)
            to = np.where((self.length[to] > 0) & (self.length[second] == 0), second, to)
            bytes_ = data[_spread(first[at], length)]
            starts, counts = self._encode(bytes_, length)
            start[new], count[new] = starts[inverse], counts[inverse]
            self.raw = _grown(self.raw, self.raw_used + len(bytes_))
            self.raw[self.raw_used : self.raw_used + len(bytes_)] = bytes_
            self.keys[to], self.start[to], self.count[to] = words, starts, counts
            self.at[to], self.length[to] = self.raw_used + np.cumsum(length) - length, length
            self.raw_used += len(bytes_)
        # after each text's words comes the end id, which stands at the front of the pool
        start, count = (np.insert(x, texts[1:], v) for x, v in ((start, 0), (count, len(self.end))))
        before = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(start - before[:-1], count) + np.arange(before[-1])]
        return ids, before[texts + np.arange(len(texts))]


def _grown(pool: np.ndarray, size: int) -> np.ndarray:
    """pool, doubled until it holds `size` elements."""
    while size > len(pool):
        pool = np.concatenate([pool, np.zeros(len(pool), pool.dtype)])
    return pool


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of `size`, one run after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _equal_runs(a: np.ndarray, b: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each run of `size` bytes (a holds them one after the other) whether b has the same at the places `at`; places outside are taken as its ends."""
    return ~np.logical_or.reduceat(a != b.take(at, mode="clip"), np.cumsum(size) - size) if len(size) else np.zeros(0, dtype=bool)


class WholeEncoder:
    """Texts to ids, text by text, for any tokenizer."""

    def __init__(self, definition: str, end: int | None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.end = Tokenizer.from_str(definition), [] if end is None else [end]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids + self.end for e in self.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])


_ENCODERS: dict[tuple, Encoder | WholeEncoder] = {}


def encoder(definition: str, end: int | None, by_words: bool) -> Encoder | WholeEncoder:
    """The worker's encoder, which the tasks that it runs one after the other share."""
    key = (hash(definition), end, by_words)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = (Encoder if by_words else WholeEncoder)(definition, end)
    return _ENCODERS[key]


def _folded(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, unless the bytes may hold a special token, or marks that compose with other letters once these are folded."""
    raw = data.tobytes()
    if b"<|" in raw:
        return data
    low = raw.lower()
    # characters before the first combining mark, U+0300 (CC 80 in UTF-8), are composed as they are
    if len(data) and data.max() >= 0xCC and not (is_normalized("NFC", raw.decode("utf-8", "surrogatepass")) and is_normalized("NFC", low.decode("utf-8", "surrogatepass"))):
        return data
    return np.frombuffer(low, dtype=np.uint8)


def vocabulary(definition: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int | None = 2, shard_ids: int = 1 << 20, by_words: bool = True) -> None:
    """Write docs(doc_id, text) in ascending doc_id order as shards of about shard_ids ids.

    A null text has no ids but the end id. A null doc_id comes first; rows of one doc_id are ordered by a
    hash of their text. tokenizer: path of a tokenizers file on the driver, whose content is broadcast (its size is fixed).
    by_words: the tokenizer is lower-casing and drops white space, so that words can be encoded by themselves.

    One shuffle, by ranges of (doc_id, hash): the ranges are sampled from these two columns.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    vocab = max(vocabulary(definition), (end or 0) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, ids, held, size, before, seq = encoder(shared.value, end, by_words), [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "first_id": [ids[0]], "before": [before], "n_docs": [len(ids)], "n_ids": [size], "image": [shard_image(ids, held, vocab)]}, schema=schema)

        for b in slices(batches, rows=1024, chars=1 << 20):
            found, at = encode(b.column(1))
            for k, i in enumerate(b.column(0).to_pylist()):
                ids.append(i)
                held.append(found[at[k] : at[k + 1]])
                size += int(at[k + 1] - at[k])
                if size >= shard_ids:
                    yield row()
                    ids, held, size, before, seq = [], [], 0, before + size, seq + 1
        if ids:
            yield row()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])
    dealt = docs.select(id_key().alias("id"), "text", F.xxhash64("text").alias("h")).repartitionByRange("id", "h").sortWithinPartitions("id", "h")
    shards = dealt.select("id", "text").mapInArrow(run, "part int, seq int, first_id long, before long, n_docs long, n_ids long, image binary")
    shards.write.option("compression", "uncompressed").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """The shard table with `start`: the ids before the shard in the whole corpus."""
    shards = spark.read.parquet(path)
    from pyspark.sql import Window

    # one row for each partition that wrote; their number is bounded by the job's number of tasks, not by the rows
    parts = shards.groupBy("part").agg(F.min("first_id").alias("least"), F.sum("n_ids").alias("total"))
    order = Window.orderBy("least", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("part_start"))
    return shards.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("before")).drop("part_start")


def read_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, unpacked from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = Shard(raw.as_buffer())
                ids = shard.range(0, shard.ids).astype("<u4").tobytes()
                s = shard.starts
                crc = [zlib.crc32(ids[4 * s[k] : 4 * s[k + 1]]) for k in range(len(s) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(s[:-1] + start, pa.int64()), pa.array(np.diff(s), pa.int64()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    out = read_shards(spark, path).select("start", "image").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
    return out.select(id_back(F.col("id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op2_token_ids(docs: DataFrame, tokenizer: str | None = None, end: int = 2, path: str | None = None) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_shards(docs, path, tokenizer, end)
    return read_documents(spark, path)
