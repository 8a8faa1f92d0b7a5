"""Each operator against a plain version, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hyperweft.llm import decontam, exactdedup, html, langid, mixing, nearjoin, secretscan, substring, tokens, toxicity
from hyperweft.llm.common import mix, text_bytes, text_names, window_names, word_hashes, word_spans
from hyperweft.llm.pages import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, n int, spans string, label int, word string"
VOWELS = "aeiou"


def word(rng, letters="bcdfglmnprst"):
    return "".join(rng.choice(letters) + rng.choice(VOWELS) for _ in range(rng.randrange(1, 4)))


def make_docs(seed=0, n=60):
    """Documents with copies, near copies, common passages, nulls, empty and long texts, and repeated rows."""
    rng = random.Random(seed)
    vocabulary = {"en": [word(rng, "bdfgth") for _ in range(120)], "de": [word(rng, "kschzw") for _ in range(120)]}
    passage = [rng.choice(vocabulary["en"]) for _ in range(70)]
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        words = [rng.choice(vocabulary[lang]) for _ in range(rng.randrange(1, 160))]
        if i % 7 == 3:
            k = rng.randrange(len(words))
            words[k:k] = passage[: rng.randrange(50, 71)]
        rows.append([i, " ".join(words), lang])
    for i in range(n, n + 12):
        base = rows[rng.randrange(n)]
        words = base[1].split(" ")
        if i % 3 == 0 and len(words) > 20:
            words[len(words) // 2] = "changed"
        rows.append([i, " ".join(words).upper() if i % 3 == 1 else " ".join(words), base[2]])
    rows += [[1000, None, "en"], [1001, "", "en"], [1002, "  \n ", None], [1003, "one", "en"], [1004, "a b c d", None], [None, rows[5][1], "en"], [None, None, None]]
    rows += [rows[8], rows[8], [3, "another text of the same id", "en"]]
    rows.append([1005, " ".join(rng.choice(vocabulary["de"]) for _ in range(6000)), "de"])
    return [(i, t, lang, "s", len(t or ""), 7, "x", 1, "y", 0, "z") for i, t, lang in rows]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(t):
    return (t or "").encode().lower()


def key(i):
    return -(2**63) if i is None else i


# --- exact dedup --------------------------------------------------------------------------------------------------


def exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r[1])].append(key(r[0]))
    return Counter((r[0], None if (k := max(groups[fold(r[1])])) == key(None) else k, len(groups[fold(r[1])]), key(r[0]) == k, hashlib.sha256(fold(r[1])).hexdigest()) for r in rows)


def test_exact_dedup(docs, rows, none):
    assert Counter(map(tuple, exactdedup.op9_exact_dedup(docs).collect())) == exact(rows)
    assert exactdedup.op9_exact_dedup(none).count() == 0


def test_exact_dedup_with_colliding_digests(spark, docs, rows):
    from pyspark.sql import functions as F

    out = exactdedup.dedup(docs, F.col("id") % 2 == 0, digest=lambda x: hashlib.sha256(x).digest()[:1] * 8)
    assert Counter((r["sha"], r["n"], r["keep"]) for r in out.collect()) == Counter((h, n, key(k)) for (_, k, n, _, h), c in exact(rows).items() for _ in range(c))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 5000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    f = exactdedup.BinaryFuse8.from_bytes(exactdedup.BinaryFuse8.build(keys).to_bytes())
    assert f.contains(keys).all()
    assert f.contains(rng.integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)).mean() < 0.01


# --- near duplicates ----------------------------------------------------------------------------------------------


def plain_near(rows, threshold=0.8):
    classes = defaultdict(list)
    for r in rows:
        classes[tuple(fold(r[1]).split())].append(key(r[0]))
    names = list(classes)
    sets = [frozenset(w[k : k + min(5, len(w))] for k in range(len(w) - min(5, len(w)) + 1)) if w else frozenset() for w in names]
    parent, links = list(range(len(names))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, w in enumerate(names):
        least[root(i)] = min(least.get(root(i), 2**63), min(classes[w]))
    return {i: (least[root(i)], min(classes[w]), links[i], w) for i, w in enumerate(names)}, names


def near_rows(rows):
    found, names = plain_near(rows)
    at = {w: i for i, w in enumerate(names)}
    back = lambda k: None if k == key(None) else k
    return Counter((r[0], *(back(k) for k in found[i][:2]), found[i][2]) for r in rows for i in [at[tuple(fold(r[1]).split())]])


def test_near_duplicates(docs, rows, none):
    assert Counter(map(tuple, nearjoin.op3_ngram_join(docs).collect())) == near_rows(rows)
    assert nearjoin.op3_ngram_join(none).count() == 0


def family(seed=2, n=40):
    """Documents of which each differs by a word or two from an earlier one, so that all hang together but not all are linked."""
    rng = random.Random(seed)
    words = [word(rng) for _ in range(150)]
    out = []
    for i in range(n):
        words = list(words) if i % 8 else [*words[:140], *(word(rng) for _ in range(10))]
        words[rng.randrange(len(words))] = word(rng) + "x"
        out.append((i, " ".join(words)))
    return out + [(500 + i, t) for i, t in out[:5]] + [(600, out[0][1].upper()), (None, out[1][1])]


@pytest.mark.parametrize("broadcast", [0, 64 << 20])
@pytest.mark.parametrize("node", [2, 400])
def test_near_duplicates_in_blocks(spark, monkeypatch, broadcast, node):
    """Pieces of more than a block, trie nodes that are too large to be compared, and tables that are too large for a broadcast."""
    monkeypatch.setattr(nearjoin, "BLOCK", 4)
    monkeypatch.setattr(nearjoin, "NODE", node)
    monkeypatch.setattr(nearjoin, "BROADCAST_BYTES", broadcast)
    rows = family()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, nearjoin.op3_ngram_join(docs).collect())) == near_rows(rows)


def test_recall_by_similarity(spark):
    """Links that the forest finds, by bands of exact similarity, over random pairs."""
    rng = random.Random(11)
    rows = []
    for k in range(400):
        words = [f"w{rng.randrange(10**7)}" for _ in range(rng.randrange(60, 200))]
        other = list(words)
        for _ in range(rng.randrange(0, 4)):
            other[rng.randrange(len(other))] = f"x{rng.randrange(10**7)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    out = {r["doc_id"]: r for r in nearjoin.op3_ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = Counter()
    for k in range(400):
        a, b = (frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for _, t in rows[2 * k : 2 * k + 2])
        s = len(a & b) / len(a | b)
        seen[min(int(s * 20), 19), out[2 * k]["class_id"] == out[2 * k + 1]["class_id"]] += 1
    for band in {b for b, _ in seen}:
        share = seen[band, True] / (seen[band, True] + seen[band, False])
        assert share >= 0.99 if band >= 16 else share == 0, band


def joined(n, edges):
    """The smallest member of each of n members' connected piece."""
    own = list(range(n))
    for _ in own:
        for i, j in edges:
            own[i] = own[j] = min(own[i], own[j])
    return own


def test_trie_walk():
    """Forests of trie nodes join what pairs with a common prefix of each length join; recall estimates follow the prefixes."""
    rng = np.random.default_rng(5)
    p = nearjoin.NearParams()
    base = [np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[: 200 - k], rng.integers(0, 2**63, k, dtype=np.uint64)])) for b in base for k in (0, 4, 8, 20, 60)]
    prefix, rest, sketch = nearjoin.signatures(sets, p)
    floor, width = nearjoin.floor_length(p), nearjoin.field_bits(p)
    assert floor == 5 and nearjoin.meets(0.8, 5, 24) >= p.recall > nearjoin.meets(0.8, 6, 24)
    total = np.zeros((p.depth + 1, 2))
    for t in range(p.trees):
        order = np.lexsort((rest[:, t], prefix[:, t]))
        x, r = prefix[order, t], rest[order, t]
        starts = np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), len(x))
        many = [(a, b) for a, b in zip(starts[:-1], starts[1:]) if b - a > 1]
        for a, b in many:
            forest, sums = nearjoin.walk(r[a:b], sketch[order][a:b], np.array([0, b - a]), p)
            total += sums
            for n in range(floor, p.depth + 1):
                cut = width * (p.depth - n)
                pairs = [(i, j) for i in range(b - a) for j in range(i) if r[a + i] >> cut == r[a + j] >> cut and (sketch[order][a + i] == sketch[order][a + j]).mean() * 256 - 1 >= 255 * (0.8 - 5 * (0.16 / 168) ** 0.5)]
                assert joined(b - a, pairs) == joined(b - a, [(u, v) for u, v, k in forest if k >= n])
    share = nearjoin.recalls(dict(enumerate(map(tuple, total))), p)
    assert share[5] >= share[6] >= share[7] > 0.99


def test_one_of_each(spark, docs, rows):
    kept = nearjoin.one_of_each(docs)
    assert kept.columns == docs.columns
    found, names = plain_near(rows)
    at = {w: i for i, w in enumerate(names)}
    want = Counter()
    for r in rows:
        w = tuple(fold(r[1]).split())
        least, copy_of, _, _ = found[at[w]]
        if not w or key(r[0]) == least == copy_of:
            want[r[:2]] += 1
    assert Counter(tuple(r[:2]) for r in kept.collect()) == want
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    few = spark.createDataFrame([(1, a), (3, a), (3, b), (4, None), (5, "")], "doc_id long, text string")
    assert Counter(map(tuple, nearjoin.one_of_each(few).collect())) == Counter([(1, a), (3, b), (4, None), (5, "")])


# --- substring dedup ----------------------------------------------------------------------------------------------


def plain_substring(rows, w=50):
    first = {}
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode()) for r in rows]
    for r, t in zip(rows, words):
        for k in range(len(t) - w + 1):
            g = tuple(t[k : k + w])
            first[g] = min(first.get(g, 2**63), key(r[0]))
    out = Counter()
    for r, t in zip(rows, words):
        gone = [False] * len(t)
        for k in range(len(t) - w + 1):
            if first[tuple(t[k : k + w])] < key(r[0]):
                gone[k : k + w] = [True] * w
        kept = [x for x, g in zip(t, gone) if not g]
        out[(r[0], len(t), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    return out


def test_substring_dedup(docs, rows, none):
    assert Counter(map(tuple, substring.op7_substring_dedup(docs).collect())) == plain_substring(rows)
    assert substring.op7_substring_dedup(none).count() == 0


def test_substring_dedup_without_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_BYTES", 0)
    assert Counter(map(tuple, substring.op7_substring_dedup(docs).collect())) == plain_substring(rows)


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_runs_without_kept_symbols(spark, monkeypatch, limit):
    monkeypatch.setattr(substring, "BROADCAST_BYTES", limit)
    texts = [(1, "ha " * 80), (2, "ha " * 120), (3, "other words"), (4, "tic tac " * 50), (5, "x " + "tic tac " * 60)]
    passage = " ".join(f"w{k}" for k in range(90))  # gives shared symbols, so that the limit of 0 is passed
    texts += [(6, passage), (7, "y " + passage)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert Counter(map(tuple, substring.op7_substring_dedup(docs).collect())) == plain_substring(texts)


def test_no_repeated_window_is_missed():
    rng = random.Random(5)
    for _ in range(60):
        size, w = rng.choice([1, 2, 3, 20, 300]), rng.choice([12, 20, 50])
        p = substring.SubstringParams(window=w, rounds=rng.choice([2, 4, 6]), longest=rng.choice([4, 8, 16]), shortest=rng.choice([1, 2, 3]))
        texts = [[rng.randrange(size) for _ in range(rng.randrange(150))] for _ in range(5)]
        for _ in range(6):
            a, b = rng.randrange(5), rng.randrange(5)
            if len(texts[a]) > w:
                i, k = rng.randrange(len(texts[a]) - w), rng.randrange(len(texts[b]) + 1)
                texts[b] = texts[b][:k] + texts[a][i : i + w + rng.randrange(30)] + texts[b][k:]
        texts[2] += [7] * 80 + texts[2][:30]
        texts[4] += [8] + [7] * 85
        h, at = mix(np.array([x for t in texts for x in t], dtype=np.uint64) + np.uint64(5)), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        s = substring.recompress(h, at, p)
        owner = np.searchsorted(at, s.start, "right") - 1
        where = defaultdict(set)
        for x, o in zip(s.name.tolist(), owner.tolist()):
            where[x].add(o)
        shared = np.array([len(where[x]) > 1 for x in s.name.tolist()], dtype=bool)
        found = set(substring.candidates(s, shared, at, len(h), p).tolist())
        windows = defaultdict(set)
        for o, t in enumerate(texts):
            for i in range(len(t) - w + 1):
                windows[tuple(t[i : i + w])].add(o)
        assert all(at[o] + i in found for o, t in enumerate(texts) for i in range(len(t) - w + 1) if len(windows[tuple(t[i : i + w])]) > 1)


# --- decontamination ----------------------------------------------------------------------------------------------


def test_decontamination(spark, docs, rows, none):
    long = [r for r in rows if r[1] and 30 <= len(r[1].split()) < 200 and r[0] is not None and r[0] < 60][:6]
    items = [(k, " ".join(r[1].split()[5:30])) for k, r in enumerate(long)] + [(90, None), (91, ""), (92, "zzz qqq"), (None, "changed")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.op8_decontamination(docs, bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}

    def holds(text, item):
        words, part = re.findall(r"\w+", text.lower()), re.findall(r"\w+", item.lower())
        row = [0] * (len(words) + 1)
        for w in part:
            new = [row[0] + 1]
            for j, x in enumerate(words):
                new.append(min(row[j] + (x != w), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row) <= int(0.2 * len(part) + 1e-9)

    want = {(r[0], i) for r in rows if r[1] for i, t in items if t and holds(r[1], t)}
    assert pairs <= want
    assert {(r[0], k) for k, r in enumerate(long)} <= pairs
    assert len(pairs) >= 0.9 * len(want)
    clean = decontam.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert decontam.op8_decontamination(none, bench).count() == 0
    assert decontam.op8_decontamination(docs, bench.limit(0)).count() == 0


def test_more_items_than_at_once(spark, docs, rows):
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) >= 30][:5]
    bench = spark.createDataFrame([(k, " ".join(t.split()[:25])) for k, t in enumerate(texts)], "item_id long, text string")
    whole = {tuple(r) for r in decontam.op8_decontamination(docs, bench).collect()}
    assert {tuple(r) for r in decontam.op8_decontamination(docs, bench, decontam.DecontamParams(index_bytes=48 * 24 * 60)).collect()} == whole


@pytest.mark.parametrize("n", [6, 30, 100])
@pytest.mark.parametrize("kind", ["head", "cut", "block", "tail"])
def test_items_are_found_wherever_the_edits_are(n, kind):
    rng = random.Random(n)
    fresh = lambda k, c: [f"{c}{rng.randrange(10**6)}" for _ in range(k)]
    most, texts = int(0.2 * n + 1e-9), []
    items = [(k, fresh(n, "w")) for k in range(60)]
    for _, x in items:
        a = {"head": 0, "cut": 0, "block": rng.randrange(n - most + 1), "tail": n - most}[kind]
        texts.append(" ".join(fresh(rng.randrange(40), "a") + x[:a] + fresh(most if kind != "cut" else 0, "x") + x[a + most :] + fresh(30, "b")))
    found = decontam.Index([(k, " ".join(x)) for k, x in items], decontam.DecontamParams()).search(pa.array(["", *texts, ""]))
    assert all(doc == i + 1 for doc, i, *_ in found)
    assert len(found) >= 0.98 * len(items)


@pytest.mark.parametrize("percent", [10, 15, 20])
@pytest.mark.parametrize("n", [8, 25, 60])
def test_recall_of_random_edits(n, percent):
    """Words replaced, dropped and put in at random places; long texts, and windows taken in parts, find the same."""
    rng = random.Random(100 * n + percent)
    fresh = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    items, texts = [(k, fresh(n)) for k in range(120)], []
    for _, x in items:
        x = list(x)
        for _ in range(int(percent / 100 * n + 1e-9)):
            i = rng.randrange(len(x))
            x[i : i + rng.choice([0, 1, 1])] = fresh(rng.choice([1, 1, 0]) or int(len(x) < 2))
        texts.append(" ".join(fresh(rng.randrange(300)) + x + fresh(30)))
    index = pickle.loads(pickle.dumps(decontam.Index([(k, " ".join(x)) for k, x in items], decontam.DecontamParams())))
    found = index.search(pa.array(texts))
    assert all(doc == i for doc, i, *_ in found)
    assert len(found) >= 0.97 * len(items)
    one = index.search(pa.array([" ".join(texts)]))
    assert {i for _, i, *_ in one} == {i for _, i, *_ in found}
    decontam.WINDOWS, before = 77, decontam.WINDOWS
    try:
        assert index.search(pa.array(texts)) == found
    finally:
        decontam.WINDOWS = before


def test_hits_looked_at_in_parts(monkeypatch):
    texts = pa.array(["ha " * 300, "x " + "ha " * 40 + "y", "no", None])
    index = decontam.Index([(1, "ha " * 40), (2, "x " + "ha " * 20)], decontam.DecontamParams())
    whole = index.search(texts)
    assert [(d, i, e) for d, i, _, e, _ in whole] == [(0, 1, 0), (0, 2, 1), (1, 1, 0), (1, 2, 0)]
    monkeypatch.setattr(decontam, "HITS", 100)
    assert index.search(texts) == whole
    assert index.search(pa.array(["nothing of it"])) == []


# --- token ids ----------------------------------------------------------------------------------------------------


def definition():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_token_ids(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(definition())
    out = sorted(map(tuple, tokens.op2_token_ids(docs).collect()), key=lambda r: r[1])
    assert [key(r[0]) for r in out] == sorted(key(r[0]) for r in rows)
    want = defaultdict(Counter)
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want[r[0]][(len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))] += 1
    got = defaultdict(Counter)
    start = 0
    for i, s, n, crc in out:
        assert s == start
        start += n
        got[i][(n, crc)] += 1
    assert got == want
    assert tokens.op2_token_ids(none).count() == 0


@pytest.mark.parametrize("width", [1, 2, 5, 8, 11, 16, 17, 31, 32])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1000, dtype=np.uint64)
    assert (tokens.unpack(tokens.pack(ids, width), 1000, width) == ids).all()


def test_shard_random_access():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 40_000, n).astype("<u4") for n in (0, 1, 5000, 4095, 1, 9000, 0)]
    shard = tokens.Shard(tokens.shard_image(list(range(7)), docs, 40_000))
    assert shard.width == 16
    for k, d in enumerate(docs):
        assert (shard.document(k) == d).all()
    narrow = tokens.Shard(tokens.shard_image(list(range(7)), [d % 1000 for d in docs], 1000))
    whole = np.concatenate(docs) % 1000
    for a, b in ((0, 0), (3, 17), (4090, 4100), (8000, 13_000), (0, len(whole))):
        assert (narrow.range(a, b) == whole[a:b]).all()


def test_words_are_encoded_as_whole_texts():
    from tokenizers import Tokenizer

    with open(definition(), encoding="utf-8") as f:
        raw = f.read()
    e, t = tokens.Encoder(raw, 2, bits=6, pool=3000), Tokenizer.from_str(raw)
    rng = random.Random(1)
    odd = list("\x01abcXYZ.,'\"!?-_019 \n\t\r\x0b\x0c\x1c\x85\xa0 éÉßİıſΣςσ̌́ñ日本語ǅ😀<|>") + ["<|endoftext|>", "<|EndOfText|>", "'s", "'LL", "J̌", "K", "Å"]
    for k in range(400):
        letters = odd if k % 2 else list("abcXYZ.,'! \n\téÉñ") + [" "] * 5
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(4)] + [None]
        ids, at = e(pa.array(texts, pa.string()))
        for j, x in enumerate(texts):
            assert ids[at[j] : at[j + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids + [2], repr(x)


class Unused:
    """In place of a tokenizer that isn't to be called."""

    def encode_batch_fast(self, *args, **kwargs):
        raise AssertionError("the whole tokenizer was called")


def test_plain_words_need_the_model_alone():
    """Words of a-z, small Latin letters, digits and signs are cut as the tokenizer cuts them, without its normalizer and pattern."""
    from tokenizers import Tokenizer

    with open(definition(), encoding="utf-8") as f:
        raw = f.read()
    e, t = tokens.Encoder(raw, 2), Tokenizer.from_str(raw)
    e.tokenizer = Unused()
    small = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
    signs = [chr(c) for c in range(33, 127) if chr(c) not in "'<"]
    rng = random.Random(3)
    for k in range(300):
        letters = ([*"abcdefgh  "], [*"etaoin", *small, " "], [*signs, *"abc 12 "])[k % 3]
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4)] + [None, "x" * 3000, " ".join(map(str, range(k, k + 1500)))][: 3 if k < 9 else 1]
        ids, at = e(pa.array(texts, pa.string()))
        for j, x in enumerate(texts):
            assert ids[at[j] : at[j + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids + [2], repr(x)
    for x in ("it's", "<|endoftext|>", "÷", "É", "a\u0301", "ŝ", "µ", "a\x1cb", "日本"):
        with pytest.raises(AssertionError, match="whole tokenizer"):
            e(pa.array([x]))


def test_other_tokenizers_are_not_cut_by_words_kinds():
    """Another pattern, normalizer or model, or special tokens of plain letters, leave all words to the whole tokenizer."""
    import json

    from tokenizers import Tokenizer

    with open(definition(), encoding="utf-8") as f:
        made = json.load(f)
    assert tokens.Pieces.of(Tokenizer.from_str(json.dumps(made))) is not None
    split, model = made["pre_tokenizer"]["pretokenizers"][0], made["model"]
    for part, change in ((split, {"pattern": {"Regex": "[^\\s]+"}}), (made, {"normalizer": {"type": "Lowercase"}}), (model, {"dropout": 0.5}), (model, {"ignore_merges": True}), (made["added_tokens"][0], {"content": "start"})):
        kept = dict(part)
        part.update(change)
        other = Tokenizer.from_str(json.dumps(made))
        assert tokens.Pieces.of(other) is None
        part.update(kept)
    split["pattern"] = {"Regex": "[^\\s]+"}
    raw = json.dumps(made)
    ids, at = tokens.Encoder(raw, 2)(pa.array(["ab12 c!! de", "x9"]))
    assert [ids[at[j] : at[j + 1]].tolist() for j in range(2)] == [Tokenizer.from_str(raw).encode(x).ids + [2] for x in ("ab12 c!! de", "x9")]


def test_two_words_of_one_place_are_both_remembered():
    """Words that share their first place in the table are encoded once each, as the second one goes to its other place."""
    with open(definition(), encoding="utf-8") as f:
        e = tokens.Encoder(f.read(), 2, bits=6)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    h = tokens.word_hashes(data, np.arange(0, len(data), 3), np.arange(3, len(data) + 3, 3))
    first, second = (h >> e.shift).tolist(), (h & e.mask).tolist()
    one, two = next((i, j) for i in range(300) for j in range(i) if first[i] == first[j] != second[i])
    pair = pa.array([words[one], words[two]])
    for x in (pair[:1], pair[1:]):
        e(x)
    e._encode = Unused()
    assert len(e(pair)[0]) > 2


# --- languages, pages, secrets, toxicity, mixing ------------------------------------------------------------------


def test_language_id(docs, rows, none):
    out = langid.op4_language_id(docs).collect()
    assert len(out) == len(rows)
    text = {r[0]: r for r in rows}
    for r in out:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    sure = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 72 and r["doc_id"] not in (3, 8) and len(text[r["doc_id"]][1]) > 60]
    assert sum(r["lang_pred"] == text[r["doc_id"]][2] for r in sure) >= 0.95 * len(sure)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1000, 1001, 1002)} == {"und"}
    assert langid.op4_language_id(none).count() == 0


def test_language_predictions_by_brute_force(docs, rows):
    p = langid.LanguageParams(dim=256)
    drawn = {}

    def vector(c):
        if c not in drawn:
            drawn[c] = np.random.default_rng((p.seed, ord(c))).integers(0, 2, p.dim, dtype=np.int8).astype(int) * 2 - 1
        return drawn[c]

    def profile(text):
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        if not letters:
            return None
        grams = Counter(zip(*((" " + " ".join(letters) + " ")[k:] for k in range(3)), strict=False))
        v = sum(n * np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for (a, b, c), n in grams.items())
        return v / np.linalg.norm(v)

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 3 == 1

    sums = {}
    for r in rows:
        if r[2] is not None and not held(r[0]) and (v := profile(r[1])) is not None:
            sums[r[2]] = sums.get(r[2], 0) + v
    langs = sorted(sums)
    protos = np.array([sums[n] / np.linalg.norm(sums[n]) for n in langs])
    want = defaultdict(list)
    for r in rows:
        if (v := profile(r[1])) is None:
            want[r[0]].append(("und", 0.0, 1.0))
            continue
        cosines = protos @ v
        e = np.exp(p.sharpness * cosines)
        want[r[0]].append((langs[cosines.argmax()], e.max() / e.sum(), np.ptp(cosines)))
    out = defaultdict(list)
    for r in langid.op4_language_id(docs, p).collect():
        assert r["held_out"] == held(r["doc_id"])
        out[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert out.keys() == want.keys()
    for i, found in out.items():
        assert len(found) == len(want[i])
        for (lang, score), (name, share, apart) in zip(sorted(found), sorted(want[i]), strict=True):
            assert abs(score - share) < 1e-3, i
            assert lang == name or apart < 1e-5, i


def test_bound_ngrams_add_up():
    p = langid.LanguageParams(dim=256)
    profile = langid.Profiler(p)
    found, has = profile(["ab", None, "1 2", "Ab, cab!"])
    assert has.tolist() == [True, False, False, True]

    def plain(text):
        v = {c: profile.vectors_of(np.array([ord(c)], dtype=np.uint64))[0].astype(int) for c in set(text)}
        return sum(np.roll(v[text[i]], 2) * np.roll(v[text[i + 1]], 1) * v[text[i + 2]] for i in range(len(text) - 2))

    assert (found[0] == plain(" ab ")).all() and (found[3] == plain(" ab cab ")).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href='/b'>News &amp; more</a></li></ul></nav><header>Site name</header><div class="cookie-notice">We use cookies on this site to make it work better for you.</div>
<article><h1>A  title</h1><p>First &lt;b&gt; para&shy;graph,
with <a href="x">a link</a>.<br>Next line.<p>Short.</p><aside>Also read this long story about something else entirely, it is great.</aside><table><tr><td>cell one<td>cell two</table>
<form><label>Name</label><input></form><div class="ad">Buy now, a very good offer for all of you, come and get it.</div></article>
<section id="comments"><p>A reader says that this is a long and thoughtful comment about the article above.</p></section><!-- <p>hidden</p> --><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    want = "A title\nFirst <b> para\xadgraph, with a link. Next line.\nShort.\ncell one\ncell two"
    assert html.main_text(PAGE) == want
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p><script>x") == ""
    assert html.main_text("<p>" + "plain words without any article around them, but enough of them to count as text" + "</p><p") == "plain words without any article around them, but enough of them to count as text"


#: Pages that the classifier has not seen; blocks of the main text start with '+'.
HELD_OUT = [
    """<div id="wrapper" class="has-menu"><div class="nav-menu"><a href="/1">{1}</a> <a href="/2">{1}</a></div><div class="main-content"><h1>+{6}</h1><p>+{51}</p><p>+{34} <a href="/x">{2}</a> {9}</p><p>+{40}</p></div><div class="footer-links"><a href="/3">{2}</a></div></div>""",
    """<header><h2>{3}</h2></header><article class="entry"><div class="entry-header"><h1>+{5}</h1></div><p>+{28}</p><div class="ad-slot"><p>{22}</p></div><p>+{63}</p><p>+{2}</p></article><div class="comments-area"><p>{33}</p><p>{50}</p></div><footer>{11}</footer>""",
    """<h1>+{8}</h1><p>+{37}</p><p>+{45}</p><ul><li>+{12}<li>+{10}</ul><p>+{66}</p><p><a href="/">{1}</a></p>""",
    """<nav><ul><li><a href="/1">{2}</a><li><a href="/2">{1}</a></ul></nav><main><div class="legal-history"><h1>+{4}</h1><p>+{48}</p><p>+{55}</p></div></main><aside>{19}</aside><div class="cookie-consent">{24}</div>""",
    """<div><a href="/1">{4}</a></div><div><a href="/2">{5}</a></div><div>{2}</div>""",
    """<div class="layout sidebar-left"><article><h1>+{7}</h1><p>+{4}</p><p>+{3}</p></article><div class="sidebar"><p>{30}</p></div></div>""",
    """<table><tr><td><a href="/1">{2}</a></td><td><p>+{58}</p><p>+{39}</p><p>+{11}</p></td></tr></table>""",
    """<div>{90}</div>""".replace("{90}", "+{90}") + """<div class="related-posts"><a href="/1">{7}</a></div><div class="subscribe"><p>{13}</p></div><form>{5}</form>""",
]


def test_blocks_of_unseen_pages():
    """Precision and recall of blocks, and the plain reading of the tree."""
    right = wrong = missed = 0
    for page in HELD_OUT:
        found = html.blocks(written(page))
        x = html.features(found)
        keep = html.classify(html.content_tree(), x)
        for k, (b, row) in enumerate(zip(found, x.tolist())):
            tree = html.content_tree()
            while isinstance(tree, tuple):
                f, t, low, high = tree
                tree = low if row[f] <= t else high
            assert bool(tree) == bool(keep[k])
            # the features of a block, by hand
            side = lambda j: (found[j][1], min(1.0, found[j][2] / found[j][1])) if 0 <= j < len(found) else (0, 0.0)  # noqa: B023, E731
            prose = sorted(w if d < 0.5 else 0 for w, d in (side(k + j) for j in (-2, -1, 1, 2)))
            assert row == [*side(k), *side(k - 1), *side(k + 1), *prose[2:], *b[3:]]
            wanted = b[0].startswith("+")
            right, wrong, missed = right + (wanted and keep[k]), wrong + (keep[k] and not wanted), missed + (wanted and not keep[k])
    print(f"held-out blocks: precision {right / (right + wrong):.3f}, recall {right / (right + missed):.3f}")
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.9


def test_tree_is_the_best_split_by_brute_force():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (40, 3)).astype(float)
    y = ((x[:, 1] > 2) & (x[:, 2] < 4)).astype(int)
    f, t, low, high = html.grow(x, y, least=1)
    cost = lambda f, t: sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[x[:, f] <= t], y[x[:, f] > t]))
    assert cost(f, t) <= min(cost(g, s - 0.5) for g in range(3) for s in np.unique(x[:, g])[1:]) + 1e-9
    assert (html.classify((f, t, low, high), x) == y.astype(bool)).all()


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="container no-sidebar"><article><h1>A title</h1><p>words of it</p></article></div>', "A title\nwords of it"),
        ('<div class="layout with-sidebar"><p>' + "some words " * 20 + "</p></div>", ("some words " * 20).strip()),
        ('<main><div class="social-science"><p>' + "some words " * 20 + "</p></div></main>", ("some words " * 20).strip()),
        ('<article><header class="entry-header"><h1>A title</h1></header><p>words of it</p></article>', "A title\nwords of it"),
        ('<article><div class="article-header"><h1>A title</h1></div><p>words of it</p></article>', "A title\nwords of it"),
        ('<div class="sidebar"><article><h1>A title</h1><p>words of it</p></article></div>', "A title\nwords of it"),
        ('<article><p>same</p><p>same</p></article><aside><article><p>another</p></article></aside>', "same\nsame"),
        ("<article><p>" + "very long " * 200_000 + "</p></article>", ("very long " * 200_000).strip()),
    ],
)
def test_wrappers_and_titles(page, want):
    assert html.main_text(page) == want


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, 4), (None, "v", "", 5)], "page_id long, url string, html string, n_chars int")
    out = {r["page_id"]: r for r in html.op5_html(pages).collect()}
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[2]["text"] == "" and out[None]["n_chars"] == 0
    assert html.op5_html(pages.limit(0)).count() == 0


SECRETS = [
    "token=token=abcdef123 Secret : 'short' api_key=\"ABCDEF0123\" PASSWORD=abc",
    "AKIA" + "Z" * 15 + " AKIA" + "Z" * 16 + " é " + "0123456789abcdef" * 2,
    "AKIA" + "Q" * 18 + " then wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12 at https://db.example.com/x",
    "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12 at https://db.example.com/x",
    None,
    "",
]


def plain_base(t):
    t = t or ""
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secrets(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(SECRETS)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in secretscan.op6_secrets(df).collect()}
    for k, t in enumerate(SECRETS):
        base = plain_base(t)
        assert out[k]["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in base).encode()).hexdigest()
        assert (out[k]["n_assign"], out[k]["n_access"], out[k]["n_hex"]) == tuple(sum(s[0] == x for s in base) for x in ("assign", "access", "hex"))
        assert out[k]["links"] == ",".join("{}:{}:{}={}:{}:{}".format(*a, *c) for a, c, _ in plain_links(t or ""))
        assert out[k]["n_links"] == sum(n for *_, n in plain_links(t or ""))
    assert "linked_key:" in out[2]["spans"] and "linked_endpoint:" in out[2]["spans"] and out[2]["n_links"] == 2
    twice = df.unionByName(df.filter("doc_id = 2"))
    assert sorted(r["spans"] for r in secretscan.op6_secrets(twice).collect() if r["doc_id"] == 2) == [out[2]["spans"]] * 2
    assert out[3]["spans"] == ""
    assert secretscan.op6_secrets(df.limit(0)).count() == 0


def plain_links(t, p=secretscan.SecretParams()):
    """Links by looking at all pairs of parts."""
    base = plain_base(t)

    def border(lo, hi):
        return re.search(r"\n[ \t\r]*\n", t[lo:hi]) is not None

    def near(a, b):
        first, second = (a, b) if a[1] <= b[1] else (b, a)
        gap = second[1] - first[2]
        return gap < p.scope or gap < p.paragraph_scope and not border(first[2], second[1])

    def pairs(cands, parts):
        out = []
        for c in cands:
            mine = [x for x in parts if near(c, x)]
            if mine:
                gap = lambda x: (c[1] - x[2], 0) if x[1] < c[1] else (x[1] - c[2], 1)  # noqa: B023, E731
                out.append((c, min(mine, key=gap), len(mine)))
        return out

    free = lambda c: all(c[2] <= x[1] or x[2] <= c[1] for x in base)
    keys = [("linked_key", *m.span()) for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])", t) if secretscan.entropy(m[0]) >= 3.5 and re.search(r"\d", m[0]) and re.search("[A-Za-z]", m[0])]
    ends = [("linked_endpoint", *m.span()) for m in secretscan.ENDPOINT.finditer(t)]
    links = pairs([k for k in keys if free(k)], [x for x in base if x[0] == "access"])
    links += pairs([e for e in ends if free(e)], [x for x in base if x[0] == "assign"] + [x[0] for x in links])
    return sorted(links, key=lambda x: (x[0][1], x[0][0] != "linked_key"))


def test_links_by_brute_force():
    rng = random.Random(2)
    bare = lambda n: "".join(rng.choice("abcdefghijkXYZ0123456789") for _ in range(n)) + "a1"
    linked = 0
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(2, 9)):
            parts.append(rng.choice([
                "AKIA" + "".join(rng.choice("ABC123") for _ in range(16)), bare(rng.choice([34, 40, 120])), f"https://h{rng.randrange(99)}.example.com/x", "password=" + bare(8), "é words", f"{rng.getrandbits(128):032x}",
            ]))
            parts.append(" " * rng.choice([1, 1, 150, 199, 200, 201, 600]) if rng.random() < 0.8 else " \n \n" + " " * rng.choice([1, 150, 300]))
        t = "".join(parts)
        spans, links = secretscan.scan(t)
        assert links == plain_links(t), t
        assert [s for s in spans if s[0].startswith("linked")] == [x[0] for x in links]
        linked += len(links)
    assert linked > 100


def test_weak_parts_need_a_complement():
    key, url, ident = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12", "https://db.example.com/x", "AKIA" + "Q" * 16
    kinds = lambda t: [s[0] for s in secretscan.scan(t)[0]]
    assert kinds(f"{key} {url}") == [] and kinds(f"password=abcdef12 {key}") == ["assign"] and kinds(f"{ident} {url}") == ["access"]
    assert kinds(f"{ident} {key} {url}") == ["access", "linked_key", "linked_endpoint"] and kinds(f"password=abcdef12 {url}") == ["assign", "linked_endpoint"]
    long = f"{ident} {key}" + " far" * 100_000 + f" {key} " + "k9Z" * 5000
    assert len(secretscan.scan(long)[1]) == 1


def test_toxicity(spark, rows, docs, none):
    rng = random.Random(9)
    bad, texts, marks = ["grobnak", "zurvik"], [], []
    for i in range(400):
        words = [word(rng) for _ in range(rng.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 15):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + (rng.choice(["o", "an", "is"]) if i % 8 else ""))
        texts.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    texts += [(500, None), (501, ""), (None, "x"), (0, texts[0][1])]
    df, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks + [(7777, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    p = toxicity.ToxicityParams(buckets=1 << 14)
    out = toxicity.op10_toxicity(df, labels, p).collect()
    assert len(out) == len(texts)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 400]
    assert sum(r["predicted"] == marks[r["doc_id"]][1] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    model = toxicity.fit(df, toxicity.learnable(labels), p)
    scorer = toxicity.Scorer(*model, p)
    assert scorer(["zurviken " + " ".join(word(rng) for _ in range(8))])[0] > scorer([" ".join(word(rng) for _ in range(8))])[0]
    assert {r["predicted"] for r in toxicity.op10_toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.op10_toxicity(none, labels).count() == 0


def plain_subwords(word, p):
    """Table rows of a word's n-grams and of the word itself, a character at a time."""
    marked, low = f"<{word}>", 2**64 - 1
    hashes = []
    for n in range(p.shortest, p.longest + 1):
        for i in range(len(marked) - n + 1):
            h = 0
            for c in marked[i : i + n]:
                h = h * 1_000_003 + ord(c)
            hashes.append(h * 0x9E3779B97F4A7C15 + n)
    hashes.append(sum(ord(c) * 0xD6E8FEB86659FD93 ** (i + 1) for i, c in enumerate(marked)))
    return [((((h & low) ^ ((h & low) >> 29)) * 0xBF58476D1CE4E5B9) & low) * p.buckets >> 64 for h in hashes]


def plain_training(texts, labels, p):
    """The weights and bias that softmax and table give, a document at a time."""
    rng = np.random.default_rng(p.seed)
    table = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim))
    soft, bias = rng.normal(0, 1, (p.dim, 2)), np.zeros(2)
    seen_t, seen_s, seen_b = np.full(p.buckets, 1e-8), np.full((p.dim, 2), 1e-8), np.full(2, 1e-8)
    bags = [[r for w in re.findall(r"\w+", (t or "").lower()) for r in plain_subwords(w, p)] for t in texts]
    keep = np.array([i for i, b in enumerate(bags) if b])
    for _ in range(p.epochs):
        rng.shuffle(keep)
        for at in range(0, len(keep), p.batch):
            picked = keep[at : at + p.batch]
            g_table, g_soft, g_bias = defaultdict(lambda: np.zeros(p.dim)), np.zeros_like(soft), np.zeros(2)
            for i in picked:
                mean = table[bags[i]].mean(0)
                e = np.exp(mean @ soft + bias)
                g = (e / e.sum() - np.eye(2)[labels[i]]) / len(picked) * 8
                for r in bags[i]:
                    g_table[r] += soft @ g / len(bags[i])
                g_soft += np.outer(mean, g)
                g_bias += g
            for r, g in g_table.items():
                seen_t[r] += (g**2).mean()
                table[r] -= p.rate * g / np.sqrt(seen_t[r])
            seen_s += g_soft**2
            soft -= 0.1 * g_soft / np.sqrt(seen_s)
            seen_b += g_bias**2
            bias -= 0.1 * g_bias / np.sqrt(seen_b)
    known = sorted({r for b in bags for r in b})
    weights = np.zeros(p.buckets)
    weights[known] = (table @ (soft[:, 1] - soft[:, 0]))[known]
    return weights, bias[1] - bias[0]


def test_toxicity_training_by_brute_force():
    rng = random.Random(4)
    p = toxicity.ToxicityParams(buckets=1 << 10, epochs=3, batch=4)
    texts = [" ".join(word(rng) for _ in range(rng.randrange(1, 9))) + (" grobnak" if i % 3 == 0 else "") for i in range(22)] + ["", None, "é Grobnak, grobnak"]
    labels = np.array([int(i % 3 == 0) for i in range(22)] + [0, 1, 1])
    weights, bias = toxicity.train(texts, labels, p)
    want, base = plain_training(texts, labels, p)
    assert abs(bias - base) < 1e-3 and np.abs(weights - want).max() < 1e-3


def test_toxicity_scores_by_brute_force(spark, docs, rows):
    p = toxicity.ToxicityParams(buckets=1 << 12, epochs=2)
    labels = spark.createDataFrame([(r[0], int(r[2] == "de")) for r in rows if r[0] is not None and r[0] < 1000], "doc_id long, toxic int").distinct()
    weights, bias = toxicity.fit(docs, toxicity.learnable(labels), p)
    memo, want = {}, []
    for r in rows:
        words = re.findall(r"\w+", (r[1] or "").lower())
        bag = np.concatenate([memo.setdefault(w, weights[plain_subwords(w, p)].astype(float)) for w in words]) if words else np.zeros(1)
        want.append((key(r[0]), 1 / (1 + np.exp(-(bag.mean() + bias)))))
    out = toxicity.score(docs.select("doc_id", "text"), (weights, bias), p).collect()
    found = sorted((key(r["doc_id"]), r["toxicity"]) for r in out)
    assert [i for i, _ in found] == sorted(i for i, _ in want)
    assert np.allclose([x for _, x in found], [x for _, x in sorted(want)], atol=1e-6)


def test_mixing(spark, docs, rows, none):
    labels = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    p = mixing.MixParams(targets={"en": 0.5, "de": 0.5}, sharpness=1.0)
    out = mixing.op1_mixing(docs, labels, p).collect()
    assert len(out) == len({(r[0], r[1]) for r in rows})
    totals = Counter()
    for r in out:
        assert r["rate"] >= 0 and abs(sum(r["posterior"].values()) - 1) < 1e-9
        assert r["n_copies"] in (int(r["rate"]), int(r["rate"]) + 1)
        for d, x in r["posterior"].items():
            totals[d] += r["rate"] * r["n_tokens"] * x
    assert abs(totals["en"] - totals["de"]) < 1e-3 * sum(totals.values())
    right = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 60 and r["n_tokens"] > 20]
    lang = {r[0]: r[2] for r in rows}
    assert sum(max(r["posterior"], key=r["posterior"].get) == lang[r["doc_id"]] for r in right) >= 0.9 * len(right)
    mixed = mixing.mixed_documents(docs, mixing.lang_labels(docs, labels), p)
    assert mixed.columns == docs.columns
    copies = {(r["doc_id"], r["n_tokens"]): r["n_copies"] for r in out}
    assert mixed.filter("doc_id = 20").count() == next(v for (i, _), v in copies.items() if i == 20)
    assert mixing.op1_mixing(none, labels, p).count() == 0
    assert mixing.op1_mixing(docs, labels.limit(0), p).count() == len(out)


def test_rates_match_a_dense_solution(spark):
    rng = np.random.default_rng(4)
    post = rng.dirichlet([0.3, 0.3, 0.3], 200)
    size = rng.integers(1, 500, 200)
    members = spark.createDataFrame([(i, int(n), *map(float, p)) for i, (n, p) in enumerate(zip(size, post))], "id long, n_tokens long, p0 double, p1 double, p2 double")
    p = mixing.MixParams(targets={"a": 0.7, "b": 0.2, "c": 0.1}, budget=float(size.sum()), rounds=200, tolerance=1e-7)
    rated, record = mixing.fit_rates(members, p)
    got = np.array([r["rate"] for r in rated.orderBy("id").collect()])
    reached = (got * size) @ post / size.sum()
    assert (got >= 0).all() and np.abs(reached - [0.7, 0.2, 0.1]).max() < 1e-5
    assert record[-1]["error"] <= record[0]["error"]
    # the same steps on a dense matrix
    a, r, wanted = (post * size[:, None]).T, np.ones(200), size.sum() * np.array([0.7, 0.2, 0.1])
    natural = a @ r
    for _ in range(len(record) - 1):
        r = np.maximum(0, r - ((a @ r - wanted) / natural) @ post.T)
    assert np.allclose(r, got, atol=1e-9) and np.allclose(a @ got, record[-1]["tokens"])
    # without a budget nothing is left out, and the shares are kept
    post = 0.98 * np.eye(3)[rng.integers(0, 3, 200)] + 0.02 * post
    members = spark.createDataFrame([(i, int(n), *map(float, x)) for i, (n, x) in enumerate(zip(size, post))], members.schema)
    rated, _ = mixing.fit_rates(members, mixing.MixParams(targets=p.targets))
    got = np.array([x["rate"] for x in rated.orderBy("id").collect()])
    totals = (got * size) @ post
    assert got.min() >= 1 and np.abs(totals / totals.sum() - [0.7, 0.2, 0.1]).max() < 1e-4


def test_posteriors_are_naive_bayes(spark, docs, rows):
    """All words and all labelled rows, against a plain naive Bayes."""
    import math

    p = mixing.MixParams(targets={"de": 0.5, "en": 0.5}, rows_per_domain=10**6, vocabulary=10**5)
    labels = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    split = lambda t: [w for w in re.split(r"[^a-z]+", (t or "").lower()) if w]
    learn = [(r[2], split(r[1])) for r in rows if r[0] is not None and r[0] < 60 and r[2] is not None]
    marks = {(r[0], r[2]) for r in rows if r[0] is not None and r[0] < 60 and r[2] is not None}
    seen = {d: Counter(w for x, ws in learn if x == d for w in ws) for d in ("de", "en")}
    # a doc_id of two languages is learned from with all its texts for both
    extra = [(d, split(r[1])) for r in rows for i, d in marks if r[0] == i and r[2] != d]
    for d, ws in extra:
        seen[d].update(ws)
    repeats = Counter((r[0], r[2]) for r in rows if r[0] is not None and r[0] < 60)
    vocabulary = set(seen["de"]) | set(seen["en"])
    prior = {d: math.log((sum(x == d for _, x in marks) + 1) / (len(marks) + 2)) for d in seen}
    out = mixing.op1_mixing(docs, labels, p).collect()
    text = defaultdict(list)
    for r in rows:
        text[r[0]].append(r[1])
    for r in out:
        if len(set(text[r["doc_id"]])) > 1:
            continue
        words = [w for w in split(text[r["doc_id"]][0])]
        known = [w for w in words if w in vocabulary]
        z = {}
        for d in seen:
            total = sum(seen[d].values()) + 0.5 * p.vocabulary
            z[d] = prior[d] + (p.sharpness * sum(math.log((seen[d][w] + 0.5) / total) for w in known) / len(known) if known else 0)
        # rows that repeat a doc_id and its text are one document
        n = len(words) * (1 if r["doc_id"] is None else Counter(x[0] for x in rows)[r["doc_id"]])
        assert r["n_tokens"] == n
        e = {d: math.exp(v - max(z.values())) for d, v in z.items()}
        assert repeats is not None and all(abs(r["posterior"][d] - e[d] / sum(e.values())) < 1e-6 for d in seen)


def thue_morse(n, a, b):
    return [(a, b)[bin(k).count("1") % 2] for k in range(n)]


def test_names_of_words_and_texts():
    a = pa.array(["one two", None, "two,one  one", "", "wo"])
    data, offsets = text_bytes(a.slice(1))
    ends = np.array([chr(c) in " ," for c in range(256)])
    start, end, texts = word_spans(data, offsets, ends)
    h = word_hashes(data, start, end)
    assert texts.tolist() == [0, 0, 3, 3, 4] and h[1] == h[2] and h[0] != h[1] and h[3] not in h[:3]
    data, offsets = text_bytes(a.slice(0, 1))
    start, end, _ = word_spans(data, offsets, ends)
    h2 = word_hashes(data, start, end)
    assert h2[0] == h[1] and h2[1] == h[0] and word_hashes(data, start, end, 1)[0] != h2[0]
    names = list(zip(*text_names([b"a b", b" a\tb ", b"ab", b"", b" "])))
    assert names[0] == names[1] != names[2] and names[3] == names[4]


def test_names_of_windows():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 7, 50):
        h = mix(rng.integers(0, 2, 400).astype(np.uint64))
        at = np.arange(len(h) - width + 1)
        names = nearest = window_names(h, at, width)
        words = [tuple(h[i : i + width].tolist()) for i in at]
        assert len(set(names.tolist())) == len(set(words)) == len(set(zip(nearest.tolist(), words)))
        assert len(window_names(h[: width - 1], np.zeros(0, np.int64), width)) == 0


def test_structured_texts_have_names_of_their_own(spark):
    """Words and texts of the Thue-Morse sequence and its complement, which collide in polynomial hashes modulo powers of 2."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(definition())
    words = ["".join(thue_morse(2048, a, b)) for a, b in ("ab", "ba")]
    texts = [" ".join(thue_morse(1024, a, b)) for a, b in (("ab", "cd"), ("cd", "ab"))]
    rows = [(1, words[0]), (2, words[1]), (3, texts[0]), (4, texts[1]), (5, words[0] + " " + words[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for r in tokens.op2_token_ids(docs).collect():
        ids = t.encode(dict(rows)[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
    assert Counter(map(tuple, substring.op7_substring_dedup(docs).collect())) == plain_substring(rows)
    assert Counter(map(tuple, nearjoin.op3_ngram_join(docs).collect())) == near_rows(rows)


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    """With all hashes equal the encoder still gives every text its own ids."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "word_hashes", lambda data, start, end: np.full(len(start), 77, np.uint64))
    with open(definition(), encoding="utf-8") as f:
        raw = f.read()
    e, t = tokens.Encoder(raw, 2), Tokenizer.from_str(raw)
    for texts in (["one"], ["two"], ["one"], ["six"], ["one two", "three", None]):
        ids, at = e(pa.array(texts, pa.string()))
        assert [ids[at[j] : at[j + 1]].tolist() for j in range(len(texts))] == [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]
