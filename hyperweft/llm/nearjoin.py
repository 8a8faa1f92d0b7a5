"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

1. A text is the set of hashes of five consecutive words (split at ASCII white space, A-Z as a-z). Texts with the
   same words, by a cryptographic name of 128 bits, are one class; its copies take part as one.
2. Each class has a label of `depth` MinHashes in each of `trees` tries. The labels of a trie are sorted, so that classes with
   a common prefix are neighbours. A trie is entered at prefixes of floor_length() MinHashes, at which a pair of
   exactly the threshold similarity meets in some trie with the target recall whatever the data are.
3. Pairs in a node are compared by sketches (one byte of every MinHash), which estimate their similarity. From the prefixes that pairs
   have in common, recalls() estimates how many of all links in the data prefixes of each length find. Matched prefixes are
   shortened from `depth` until that reaches the target, or at the latest at the floor. A node gives a spanning forest of its pairs that
   may be links, with the length of the prefix at which they meet, never all its pairs; nodes of more than NODE classes
   give a star, where they are.
4. Candidates in a connected piece of these forests are verified together. A piece of more than BLOCK classes is cut, in the order of
   the first trie's labels, into blocks, and two blocks meet only if a trie node holds classes of both. A task holds two blocks at most;
   a sparse product counts all intersections at once; only each class's number of links and a spanning forest of the
   links leave it.
5. Groups of near-duplicates are the components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperweft.llm.common import BROADCAST_BYTES, FOLD, SPACES, hashed_words, id_back, id_key, join_hot, materialize, mix, shingles, slices, text_bytes, text_names
from hyperweft.operators.graph import components
from hyperweft.plans.storage import numbered

#: Classes that a task compares with each other, or with as many others.
BLOCK = 400
#: Classes of a trie node up to which its pairs are compared by sketches.
NODE = 400
#: Estimates may be this many standard deviations too low: one pair of 3 million at the threshold.
DEVIATIONS = 5


@dataclass(frozen=True)
class NearParams:
    words: int = 5
    threshold: float = 0.8
    trees: int = 24
    depth: int = 7
    recall: float = 0.9999
    seed: int = 3


def meets(s, k: int, trees: int):
    """How likely a pair of similarity s is to have a prefix of k MinHashes in common in some trie."""
    return 1 - (1 - s**k) ** trees


def floor_length(p: NearParams) -> int:
    """The longest prefix at which a pair of the threshold similarity meets with the target recall, or 1."""
    return next((k for k in range(p.depth, 1, -1) if meets(p.threshold, k, p.trees) >= p.recall), 1)


def field_bits(p: NearParams) -> int:
    """Bits of each MinHash of a label beyond the floor, which are packed into one 64-bit integer."""
    return min(20, 62 // max(1, p.depth - floor_length(p)))


def named_sets(column: pa.Array, words: int) -> tuple[tuple[np.ndarray, np.ndarray], list[np.ndarray]]:
    """Each text's name of 128 bits, and its set of shingle hashes."""
    data, offsets = text_bytes(column)
    h, texts = hashed_words(FOLD[data], offsets, SPACES)
    return text_names((t or b"").lower() for t in column.cast(pa.binary()).to_pylist()), shingles(h, texts, words)


#: The name of texts without words.
NO_WORDS = tuple(int(x[0]) for x in text_names([b""]))


def signatures(sets: list[np.ndarray], p: NearParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each nonempty set and trie the hash of the floor's prefix and the rest of the label, and the sketch of all MinHashes."""
    rng = np.random.default_rng(p.seed)
    n = p.trees * p.depth
    odd = rng.integers(1, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, n, dtype=np.uint64)
    floor, width = floor_length(p), np.uint64(field_bits(p))
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    prefix, rest = np.zeros((len(sets), p.trees), dtype=np.uint64), np.zeros((len(sets), p.trees), dtype=np.uint64)
    sketch = np.zeros((len(sets), n), dtype=np.uint8)
    for j in range(n):
        h = flat * odd[2 * j] + add[j]
        h ^= h >> np.uint64(32)
        least = mix(np.minimum.reduceat(h * odd[2 * j + 1], at))
        sketch[:, j] = least >> np.uint64(56)
        t, k = divmod(j, p.depth)
        if k < floor:
            prefix[:, t] = mix(prefix[:, t] + least)
        else:
            rest[:, t] = (rest[:, t] << width) | (least & ((np.uint64(1) << width) - np.uint64(1)))
    return prefix.view(np.int64), rest.view(np.int64), sketch


def signed(docs: DataFrame, p: NearParams) -> DataFrame:
    """(id, h, n1, n2, label, sketch): docs(doc_id, text) by name; labels and sketches are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=128, chars=1 << 20, text=2):
            names, sets = named_sets(b.column(2), p.words)
            full = [i for i, s in enumerate(sets) if len(s)]
            label: list[bytes | None] = [None] * len(sets)
            sketch = list(label)
            if full:
                for i, *row in zip(full, *signatures([sets[i] for i in full], p), strict=True):
                    label[i], sketch[i] = row[0].tobytes() + row[1].tobytes(), row[2].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, names), pa.array(label, pa.binary()), pa.array(sketch, pa.binary())], ["id", "h", "n1", "n2", "label", "sketch"])

    return docs.select(id_key().alias("id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "id long, h long, n1 long, n2 long, label binary, sketch binary")


def labels(classes: DataFrame, p: NearParams) -> DataFrame:
    """(tree, prefix, rest, class) of classes(class, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.int64).reshape(-1, 2, p.trees)
            cols = [np.tile(np.arange(p.trees, dtype=np.int32), b.num_rows), both[:, 0].ravel(), both[:, 1].ravel(), np.repeat(b.column(0).to_numpy(), p.trees)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["tree", "prefix", "rest", "class"])

    return classes.mapInArrow(run, "tree int, prefix long, rest long, class long")


def members(classes: DataFrame, p: NearParams) -> DataFrame:
    """(tree, prefix, rest, class, n, hub) of all trie nodes of two or more classes; hub is the smallest of them."""
    every = labels(classes.filter("label is not null").select("class", "label"), p)
    nodes = every.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.min("class").alias("hub")).filter("n > 1")
    nodes = materialize(nodes, "nodes")
    if nodes.count() * 48 <= BROADCAST_BYTES:
        return materialize(every.join(F.broadcast(nodes), ["tree", "prefix"]), "members")
    return materialize(join_hot(every, nodes, ["tree", "prefix"], "n", NODE), "members")


def pieces(linked: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest member of each member's connected piece, where `label` holds pieces that are known already."""
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def walk(rest: np.ndarray, sketch: np.ndarray, starts: np.ndarray, p: NearParams) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Nodes (members from starts on, in the order of their labels) to a forest (member, member, length of the prefix) and the sums for recalls()."""
    floor, width = floor_length(p), field_bits(p)
    spread = np.sqrt(p.threshold * (1 - p.threshold) / sketch.shape[1])
    forest: list[tuple[int, int, int]] = []
    sums = np.zeros((p.depth + 1, 2))
    sizes = np.diff(starts)
    for c in np.unique(sizes).tolist():
        i, j = np.triu_indices(c, 1)
        at = starts[:-1][sizes == c]
        for k in range(0, len(at), max(1, 20_000 // len(i))):
            some = at[k : k + max(1, 20_000 // len(i))]
            a, b = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
            # bytes agree by chance one time in 256
            s = np.clip(((sketch[a] == sketch[b]).mean(axis=1) * 256 - 1) / 255, 0.0, 1.0)
            length = np.full(len(a), floor)
            alike = np.ones(len(a), dtype=bool)
            for f in range(p.depth - floor):
                shift = (p.depth - floor - 1 - f) * width
                alike &= (rest[a] >> shift) == (rest[b] >> shift)
                length += alike
            sure = s >= p.threshold - spread
            for n in range(floor, p.depth + 1):
                x = s[sure & (length >= n)]
                sums[n] += (meets(x, n, p.trees) / (p.trees * x**n)).sum(), (1 / (p.trees * x**n)).sum()
            maybe = s >= p.threshold - DEVIATIONS * spread
            if c == 2:
                forest += [(int(x), int(x) + 1, int(n)) for x, n in zip(a[maybe], length[maybe], strict=True)]
                continue
            for g in np.flatnonzero(maybe.reshape(len(some), -1).any(axis=1)).tolist():
                mine = slice(g * len(i), (g + 1) * len(i))
                label = np.arange(c)
                for n in range(p.depth, floor - 1, -1):
                    hit = maybe[mine] & (length[mine] >= n)
                    linked = np.zeros((c, c), dtype=bool)
                    linked[i[hit], j[hit]] = linked[j[hit], i[hit]] = True
                    new = pieces(linked, label)
                    forest += [(int(some[g] + new[x]), int(some[g] + x), n) for x in np.flatnonzero((label == np.arange(c)) & (new != label)).tolist()]
                    label = new
    return forest, sums


def recalls(sums: dict[int, tuple[float, float]], p: NearParams) -> dict[int, float]:
    """The share of all links that prefixes of each length find, as the data tell.

    A pair of similarity s is expected to share a prefix of k in trees * s^k tries, so that each sighting stands for the inverse of that many
    pairs, seen or not, of which meets(s, k) are found.
    """
    return {k: a / b if b else 1.0 for k, (a, b) in sums.items()}


def candidates(found: DataFrame, classes: DataFrame, p: NearParams) -> DataFrame:
    """(u, v): forests of the nodes of members(), for prefixes that reach the target recall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = ["u", "v", "length", "seen", "links"]

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            tree, prefix, member = (t.column(k).to_numpy() for k in (0, 1, 3))
            starts = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])]))
            sketch = np.frombuffer(b"".join(t.column(4).to_pylist()), dtype=np.uint8).reshape(len(member), -1)
            forest, sums = walk(t.column(2).to_numpy(), sketch, np.append(starts, len(member)), p)
            u, v, n = np.array(forest, dtype=np.int64).reshape(-1, 3).T
            lengths = np.arange(len(sums))
            empty = pa.nulls(len(sums), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(member[u]), pa.array(member[v]), pa.array(n.astype(np.int32)), *(pa.nulls(len(u), pa.float64()) for _ in range(2))], names)
            yield pa.RecordBatch.from_arrays([empty, empty, pa.array(lengths.astype(np.int32)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names)

        for b in batches:
            if not b.num_rows:
                continue
            tree, prefix = b.column(0).to_numpy(), b.column(1).to_numpy()
            last = int(np.flatnonzero((tree != tree[-1]) | (prefix != prefix[-1]))[-1]) + 1 if (tree[0], prefix[0]) != (tree[-1], prefix[-1]) else 0
            if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (tree[0], prefix[0]):
                yield from done(pa.Table.from_batches(held))
                held = []
            if last:
                yield from done(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield from done(pa.Table.from_batches(held))

    light = found.filter(F.col("n") <= NODE).select("tree", "prefix", "rest", "class").join(classes.select("class", "sketch"), "class")
    light = light.select("tree", "prefix", "rest", "class", "sketch").repartition("tree", "prefix").sortWithinPartitions("tree", "prefix", "rest", "class")
    forest = materialize(light.mapInArrow(run, "u long, v long, length int, seen double, links double"), "forest")
    sums = forest.filter("u is null").groupBy("length").agg(F.sum("seen").alias("seen"), F.sum("links").alias("links")).collect()  # one row a length
    share = recalls({r["length"]: (r["seen"], r["links"]) for r in sums}, p)
    floor = floor_length(p)
    length = next((k for k in range(p.depth, floor, -1) if share.get(k, 1.0) >= p.recall), floor)
    stars = found.filter((F.col("n") > NODE) & (F.col("class") != F.col("hub"))).select(F.col("hub").alias("u"), F.col("class").alias("v"))
    return forest.filter(F.col("length") >= length).filter("u is not null").select("u", "v").unionByName(stars)


def verify(members: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links between sets: each one's number, and a spanning forest of them.

    side: 0 and 1 for the two blocks, whose pairs across are counted; all 0 for one block with itself.
    Sets are taken SLICE at a time against all; hashes that occur once can't be shared and are left out.
    """
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[name] > 1
    name, owner = name[shared], owner[shared]
    order = np.argsort(name, kind="stable")  # postings: owners by hash
    owner_by, name_by = owner[order], name[order]
    first = np.searchsorted(name_by, np.arange(len(count)))
    across = bool(side.any())
    links, parent, forest = np.zeros(len(sets), dtype=np.int64), np.arange(len(sets)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    starts = np.searchsorted(owner, np.arange(len(sets) + 1))
    for i in range(len(sets)):
        if across and side[i]:
            continue
        mine = name[starts[i] : starts[i + 1]]
        if not len(mine):
            continue
        n = count[mine]
        at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner_by[at], minlength=len(sets))
        hit = common >= threshold * (sizes + sizes[i] - common) - 1e-9
        hit &= side == 1 if across else np.arange(len(sets)) > i
        found = np.flatnonzero(hit)
        links[i] += len(found)
        links[found] += 1
        for j in found.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                forest.append((int(members[i]), int(members[j])))
    return links, forest


def placed_classes(classes: DataFrame, found: DataFrame, p: NearParams) -> tuple[DataFrame, DataFrame]:
    """(class, block) of all classes that may have links, and the pairs (i, j) of blocks that meet, i < j.

    Pieces of at most BLOCK classes are one block with a negative number.
    """
    clusters = materialize(components(candidates(found, classes, p)).select(F.col("node").alias("class"), F.col("root").alias("cluster")), "clusters")
    sizes = materialize(clusters.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK), "large")
    few = sizes.count()
    marked = F.broadcast(sizes) if few * 48 <= BROADCAST_BYTES else sizes
    whole = clusters.join(marked, "cluster", "left_anti").select("class", (-1 - F.col("cluster")).alias("block"))
    if not few:
        return whole, classes.sparkSession.createDataFrame([], "i long, j long")
    large = clusters.join(marked.select("cluster"), "cluster").join(classes.select("class", "label"), "class")
    # the first trie's label is at the front, and the rest of it after all prefixes
    large = large.select("cluster", F.substring("label", 1, 8).alias("a"), F.substring("label", 8 * p.trees + 1, 8).alias("b"), "class")

    # of BLOCK classes each, whatever the partitions; where two pieces meet a block may hold some of both, which are compared then
    order = [F.col(c) for c in ("cluster", "a", "b", "class")]
    cut = numbered(large, order, "at").select("class", "cluster", F.floor((F.col("at") - 1) / BLOCK).cast("long").alias("block"))
    cut = materialize(cut, "blocks")
    # a node's classes may be in several pieces, which never meet
    where = found.select("tree", "prefix", "class").join(cut, "class").select("tree", "prefix", "cluster", "block").distinct()
    where = materialize(where, "where")
    met = where.select("tree", "prefix", "cluster", F.col("block").alias("i")).join(where.withColumnRenamed("block", "j"), ["tree", "prefix", "cluster"]).filter("i < j")
    return materialize(whole.unionByName(cut.select("class", "block")), "placed"), materialize(met.select("i", "j").distinct(), "meetings")


def links(docs: DataFrame, params: NearParams = NearParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows (id, h, n1, n2), classes (class, n1, n2, rep, n_rows), found (u, v, n)) of docs(doc_id, text).

    found: rows without v give a class's number of links, others are links that span the groups. rep is the smallest
    doc_id of a class, n_rows its rows.
    """
    p = params
    rows = materialize(signed(docs, p), "signed")
    # copies of a class have equal signatures: any one stands for it. Classes are numbered as they are written
    classes = rows.groupBy("n1", "n2").agg(F.min("id").alias("rep"), F.count("*").alias("n_rows"), F.first("label").alias("label"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    placed, meetings = placed_classes(classes, members(classes, p), p)
    placed = materialize(placed.join(classes.select("class", "n1", "n2", "rep"), "class"), "placed")
    sets = _shingled(docs, placed, p)
    dealt = sets.select(F.col("block").alias("i"), F.col("block").alias("j"), "class", F.lit(0).alias("side"), "set")
    if not meetings.isEmpty():
        far = F.broadcast(meetings) if meetings.count() * 32 <= BROADCAST_BYTES else meetings
        across = [sets.join(far, F.col("block") == F.col(c)).select("i", "j", "class", F.lit(side).alias("side"), "set") for side, c in enumerate("ij")]
        dealt = dealt.unionByName(across[0]).unionByName(across[1])

    def check(keys: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("class")
        members = t.column("class").to_numpy()
        # a doc_id with two rows of one class gives its set once
        first = np.concatenate([[True], members[1:] != members[:-1]])
        raw = [np.frombuffer(x, dtype=np.uint64) for x, f in zip(t.column("set").to_pylist(), first, strict=True) if f]
        side, members = t.column("side").to_numpy()[first], members[first]
        n, forest = verify(members, side, raw, p.threshold)
        hit = n > 0
        u = members[hit].tolist() + [x for x, _ in forest]
        v = [None] * int(hit.sum()) + [y for _, y in forest]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n[hit].tolist() + [0] * len(forest), pa.int64())})

    found = materialize(dealt.groupBy("i", "j").applyInArrow(check, "u long, v long, n long"), "links")
    return rows.select("id", "h", "n1", "n2"), classes.select("class", "n1", "n2", "rep", "n_rows"), found


def _shingled(docs: DataFrame, placed: DataFrame, p: NearParams) -> DataFrame:
    """(class, block, set): the shingles of each class's text. Where placed is within the broadcast bound its texts are found in place, else by a shuffle."""
    keyed = docs.select(id_key().alias("rep"), "text")
    side = F.broadcast(placed) if placed.count() * 64 <= BROADCAST_BYTES else placed
    joined = keyed.join(side, "rep").select("class", "text", "n1", "n2", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, chars=1 << 20):
            (n1, n2), sets = named_sets(b.column(1), p.words)
            keep = np.flatnonzero((n1 == b.column(2).to_numpy()) & (n2 == b.column(3).to_numpy()))  # a repeated doc_id may have another text
            part, sets = b.take(pa.array(keep)), [sets[i].tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(4), pa.array(sets, pa.binary())], ["class", "block", "set"])

    return materialize(joined.mapInArrow(run, "class long, block long, set binary"), "sets")


def near_duplicates(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """(id, h, copy_of, class_id, first1, first2, n1, n2, n_links) for each row of docs(doc_id, text).

    copy_of: the smallest doc_id with the same words. class_id: the smallest doc_id of the group, and first1 and first2 the name
    of its text (of several, the smallest). n_links: different texts that the text is linked with; copies aren't counted.
    h: a hash of the text. Texts without words (null, empty, white space) are one class without links; a text of
    fewer than five words is one shingle.
    """
    rows, classes, found = links(docs, params)
    counts = found.filter("v is null").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("n_links"))
    grouped = components(found.filter("v is not null").select("u", "v")).select(F.col("node").alias("class"), F.col("root").alias("group"))
    grouped = materialize(grouped.join(counts, "class").join(classes.select("class", "n1", "n2", "rep"), "class"), "grouped")
    first = grouped.groupBy("group").agg(F.min(F.struct("rep", "n1", "n2")).alias("k"), F.count("*").alias("n"))
    first = materialize(first.select("group", F.col("k.rep").alias("class_id"), F.col("k.n1").alias("first1"), F.col("k.n2").alias("first2"), "n"), "groups")
    linked = materialize(join_hot(grouped, first, ["group"], "n").select("class", "class_id", "first1", "first2", "n_links"), "linked")
    side = F.broadcast(linked) if linked.count() * 48 <= BROADCAST_BYTES else linked
    named = classes.join(side, "class", "left").select(
        "n1", "n2", "n_rows", F.col("rep").alias("copy_of"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("first1", "n1").alias("first1"), F.coalesce("first2", "n2").alias("first2"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    return join_hot(rows, materialize(named, "named"), ["n1", "n2"], "n_rows").drop("n_rows")


def op3_ngram_join(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the group), copy_of (the smallest doc_id with the same words), n_links."""
    found = near_duplicates(docs, params)
    return found.select(id_back(F.col("id")).alias("doc_id"), id_back(F.col("class_id")).alias("class_id"), id_back(F.col("copy_of")).alias("copy_of"), "n_links")


def one_of_each(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """Rows of docs but for near-duplicates and copies: of each group the row with the smallest doc_id stays, of several texts under that
    doc_id the one whose name is smallest.

    Texts without words are kept: they aren't near-duplicates of anything. Rows that repeat the kept row's doc_id and words all stay.
    """
    found = near_duplicates(docs, params)
    stays = (F.col("id") == F.col("class_id")) & (F.col("n1") == F.col("first1")) & (F.col("n2") == F.col("first2"))
    empty = (F.col("n1") == NO_WORDS[0]) & (F.col("n2") == NO_WORDS[1])
    drop = materialize(found.filter(~stays & ~empty).select(F.col("id").alias("__hw_id"), F.col("h").alias("__hw_h")).distinct(), "dropped")
    side = F.broadcast(drop) if drop.count() * 32 <= BROADCAST_BYTES else drop
    keyed = docs.withColumn("__hw_id", id_key()).withColumn("__hw_h", F.xxhash64("text"))
    return keyed.join(side, ["__hw_id", "__hw_h"], "left_anti").select(*docs.columns)
