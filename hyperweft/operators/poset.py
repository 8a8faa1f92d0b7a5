"""The inclusion poset of vertices and hyperedges, and Forman-Ricci curvature on it.

Members of the poset are whole numbers, so that joins compare numbers: 2 * node for a vertex, 2 * edge + 1 for a hyperedge. named() gives
their names 'v<node>' and 'e<edge>'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperweft.operators.incidence import degrees, hyperedges, with_card
from hyperweft.plans.storage import cut, small

#: Larger hyperedges aren't expanded into pairs of nodes; they are found by single nodes.
PAIR_CARD = 40

#: Of a hyperedge, so many of its rarest nodes are looked for in larger hyperedges than that.
PROBES = 8

#: Words of the filter of the pairs that subsets look for: at most 1 << 20 rows are broadcast.
PAIR_WORDS = 1 << 20


def _sets(inc: DataFrame) -> DataFrame:
    """(edge, nodes, card, probe, mask), written once: nodes in order, the PROBES rarest of them from the rarest on, and 64 hashed bits of the set."""
    inc = cut(inc, "inc")
    degree = cut(degrees(inc), "degrees")
    # dealt by hyperedge before it is grouped, as lists collected in part would be shuffled with their overhead
    ranked = inc.repartition("edge").join(F.broadcast(degree), "node") if small(degree, 64) else inc.join(degree, "node").repartition("edge")
    e = ranked.groupBy("edge").agg(F.array_sort(F.collect_list(F.struct("degree", "node"))).alias("r"))
    e = e.select("edge", F.array_sort("r.node").alias("nodes"), F.size("r").alias("card"), F.slice("r.node", 1, PROBES).alias("probe"))
    return cut(e.withColumn("mask", F.expr("aggregate(nodes, 0L, (m, x) -> m | shiftleft(1L, cast(pmod(xxhash64(x), 64) as int)))")), "sets")


def _contained(e: DataFrame) -> DataFrame:
    """(low, high, low_card, high_card, low_nodes): of the sets of at least two nodes in e, those that are strict subsets of larger ones.

    No row that is dealt out carries the nodes of a superset: candidates are numbers. A pair is in every set that it was found in; larger
    candidates are verified on the arrays when few are left, which come to them where the sets are, as far as candidates can be broadcast.
    """
    e = e.filter("card > 1")
    low = e.select(F.col("edge").alias("low"), F.col("card").alias("low_card"), F.col("mask").alias("low_mask"), "probe", F.array_min(F.slice("probe", 1, 2)).alias("a"), F.array_max(F.slice("probe", 1, 2)).alias("b"))
    at = [F.pmod(F.shiftright(F.xxhash64("a", "b"), 6), F.lit(PAIR_WORDS)).alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(a, b), 64) as int))").alias("bit")]
    # of the pairs of nodes only those are dealt out that a subset may look for
    wanted = cut(low.select(*at).groupBy("word").agg(F.bit_or("bit").alias("bits")), "wanted")
    pairs = e.filter((F.col("card") > 2) & (F.col("card") <= PAIR_CARD)).select(F.col("edge").alias("high"), F.col("card").alias("high_card"), F.col("mask").alias("high_mask"), "nodes", F.posexplode("nodes").alias("i", "a"))
    pairs = pairs.select("high", "high_card", "high_mask", "a", F.explode(F.expr("slice(nodes, i + 2, greatest(high_card - i - 1, 0))")).alias("b"))
    pairs = pairs.select("*", *at).join(F.broadcast(wanted), "word").filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("a", "b", "high", "high_card", "high_mask")
    found = low.drop("probe").join(pairs, ["a", "b"]).filter((F.col("low_card") < F.col("high_card")) & (F.col("low_mask").bitwiseAND(F.bitwise_not("high_mask")) == 0))
    found = cut(found.select("low", "high", "low_card", "high_card", "a", "b"), "found")
    sure = found.filter("low_card = 2").select("low", "high", "low_card", "high_card", F.array("a", "b").alias("low_nodes"))
    rest = found.filter("low_card > 2").select("low", "high", "low_card", "high_card")
    large = e.filter(F.col("card") > PAIR_CARD)
    if not large.isEmpty():
        large = large.select(F.col("edge").alias("high"), F.col("card").alias("high_card"), F.explode("nodes").alias("node"))
        probes = low.select("low", "low_card", F.size("probe").alias("n"), F.explode("probe").alias("node"))
        hits = probes.join(large, "node").filter("low_card < high_card").groupBy("low", "high", "low_card", "high_card", "n").agg(F.count("*").alias("hits"))
        rest = cut(rest.unionByName(hits.filter("hits = n").drop("n", "hits")), "found")
    few = small(rest, 128)
    lows, highs = (e.select(F.col("edge").alias(c), F.col("nodes").alias(f"{c}_nodes")) for c in ("low", "high"))
    rest = cut(lows.join(F.broadcast(rest) if few else rest, "low"), "candidates")
    rest = highs.join(F.broadcast(rest) if few else rest, "high").filter(F.size(F.array_intersect("low_nodes", "high_nodes")) == F.col("low_card"))
    return sure.unionByName(rest.drop("high_nodes"))


def edge_containments(inc: DataFrame, least: int = 1) -> DataFrame:
    """(low, high, low_card, high_card): hyperedges of at least `least` nodes that are strict subsets of larger ones.

    An equi-join in place of the subset test: a subset meets its supersets on its two rarest nodes, which
    selects far better than one node, and is verified on the arrays. Supersets with more than PAIR_CARD nodes are met on
    the PROBES rarest nodes, all of which they have to hold.
    """
    e = _sets(inc)
    found = _contained(e.filter(F.col("card") >= least)).drop("low_nodes")
    if least > 1:
        return found
    # a hyperedge of one node is in all larger ones that hold it
    alone = e.filter("card = 1").select(F.col("edge").alias("low"), F.col("card").alias("low_card"), F.col("nodes")[0].alias("node"))
    member = e.filter("card > 1").select(F.col("edge").alias("high"), F.col("card").alias("high_card"), F.explode("nodes").alias("node"))
    return found.unionByName(alone.join(member, "node").select("low", "high", "low_card", "high_card"))


def vertex(node="node") -> Column:
    return 2 * F.col(node)


def hyperedge(edge="edge") -> Column:
    return 2 * F.col(edge) + 1


def is_vertex(member: str) -> Column:
    return F.col(member) % 2 == 0


def named(df: DataFrame, *columns: str) -> DataFrame:
    """df with names in place of members in columns."""
    return df.withColumns({c: F.concat(F.when(is_vertex(c), "v").otherwise("e"), F.shiftright(c, 1).cast("string")) for c in columns})


def containments(inc: DataFrame) -> DataFrame:
    """(low, high) of all strict containments among vertices and hyperedges."""
    of_nodes = with_card(inc, 2).select(vertex().alias("low"), hyperedge().alias("high"))
    return of_nodes.unionByName(edge_containments(inc).select(hyperedge("low").alias("low"), hyperedge("high").alias("high")))


def _hasse(inc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The Hasse relation in short: (low, high, low_nodes) of hyperedges, (edge, card, nodes) with the vertices that each hyperedge of at least two nodes covers, and (node, single).

    What lies between two members is a hyperedge of at least two nodes, so only these are composed with each other. A vertex is covered by a
    hyperedge that it is in, unless it is in one that the hyperedge covers; and so is each hyperedge `single` of that node alone.
    """
    e = _sets(inc)
    inside = cut(_contained(e).select("low", "high", "low_nodes"), "contained")
    via = inside.select("low", F.col("high").alias("mid")).join(inside.select(F.col("low").alias("mid"), "high"), "mid").select("low", "high").distinct()
    of_edges = cut(inside.join(via, ["low", "high"], "left_anti"), "covers")
    of_nodes = e.filter("card > 1").select("edge", "card", "nodes")
    held = of_edges.select(F.col("high").alias("edge"), F.explode("low_nodes").alias("node")).groupBy("edge").agg(F.collect_set("node").alias("held"))
    left = F.when(F.col("held").isNull(), F.col("nodes")).otherwise(F.array_except("nodes", "held"))
    open_ = cut(of_nodes.join(held, "edge", "left").select("edge", "card", left.alias("nodes")), "open")
    return of_edges, open_, e.filter("card = 1").select(F.col("nodes")[0].alias("node"), F.col("edge").alias("single"))


def covers(inc: DataFrame, vertices: Column | None = None) -> DataFrame:
    """(low, high): the Hasse relation, containments with nothing in between.

    vertices: a condition on `node`, if not all vertices take part.
    """
    of_edges, open_, single = _hasse(inc)
    member = open_.select("edge", F.explode("nodes").alias("node"))
    found = (member.filter(vertices) if vertices is not None else member).select(vertex().alias("low"), hyperedge().alias("high"))
    found = found.unionByName(member.join(single, "node").select(hyperedge("single").alias("low"), hyperedge().alias("high")))
    return found.unionByName(of_edges.select(hyperedge("low").alias("low"), hyperedge("high").alias("high")))


def triangles(cover: DataFrame) -> DataFrame:
    """(i, j, k): chains of two covers."""
    upper = cover.filter(~is_vertex("low")).select(F.col("low").alias("j"), F.col("high").alias("k"))  # nothing is below a vertex
    return cover.select(F.col("low").alias("i"), F.col("high").alias("j")).join(upper, "j").select("i", "j", "k")


def poset_edges(cover: DataFrame) -> DataFrame:
    """(u, v, tri): covers and two-step edges, with the number of triangles on each."""
    cover = cut(cover, "covers")
    t = triangles(cover)
    sides = t.select(F.col("i").alias("u"), F.col("j").alias("v")).unionByName(t.select(F.col("j").alias("u"), F.col("k").alias("v"))).unionByName(t.select(F.col("i").alias("u"), F.col("k").alias("v")))
    counts = sides.groupBy("u", "v").agg(F.count("*").alias("tri"))
    # a two-step edge is a side of a triangle; covers without triangles come from the left
    return cover.select(F.col("low").alias("u"), F.col("high").alias("v")).join(counts, ["u", "v"], "full").select("u", "v", F.coalesce("tri", F.lit(0)).alias("tri"))


def forman_edges(edges: DataFrame) -> DataFrame:
    """(u, v, curvature) = 4 - deg u - deg v + 3 tri."""
    edges = cut(edges, "poset")
    both = edges.select(F.col("u").alias("n")).unionByName(edges.select(F.col("v").alias("n")))
    deg = both.groupBy("n").agg(F.count("*").alias("deg"))
    out = edges.join(deg.withColumnsRenamed({"n": "u", "deg": "du"}), "u").join(deg.withColumnsRenamed({"n": "v", "deg": "dv"}), "v")
    return out.select("u", "v", (4 - F.col("du") - F.col("dv") + 3 * F.col("tri")).alias("curvature"))


def forman_graph(inc: DataFrame) -> DataFrame:
    """forman_edges of a hypergraph's poset, written once for those who use it more often."""
    return cut(forman_edges(poset_edges(covers(inc))), "forman")


def forman_nodes(curved: DataFrame) -> DataFrame:
    """(member, curvature): the sum over the incident edges of every member of the poset."""
    both = curved.select(F.col("u").alias("member"), "curvature").unionByName(curved.select(F.col("v").alias("member"), "curvature"))
    return both.groupBy("member").agg(F.sum("curvature").alias("curvature"))


def _chains(of_edges: DataFrame, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, j, k) and (i, j, k): chains of two covers from vertices and from hyperedges on, written once; hyperedges of one node are as their vertices.

    A pair covers both of its vertices, which come with it. Of larger hyperedges the covered ones are looked up.
    """
    upper = of_edges.select(F.col("low").alias("j"), F.col("high").alias("k"))
    larger = of_edges.filter(F.size("low_nodes") > 2).select(F.col("low").alias("j"), F.col("high").alias("k"))
    looked_up = open_.filter("card > 2").select(F.col("edge").alias("j"), "nodes").join(F.broadcast(larger) if small(larger, 64) else larger, "j").select("nodes", "j", "k")
    pairs = of_edges.filter(F.size("low_nodes") == 2).select(F.col("low_nodes").alias("nodes"), F.col("low").alias("j"), F.col("high").alias("k"))
    from_nodes = cut(pairs.unionByName(looked_up).select(F.explode("nodes").alias("node"), "j", "k"), "chains")
    return from_nodes, cut(of_edges.select(F.col("low").alias("i"), F.col("high").alias("j")).join(upper, "j").select("i", "j", "k"), "chains")


def forman_sums(inc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edge, card, curvature), and the vertices below hyperedges, as (edge, nodes) for covers and (edge, node) for two-step edges.

    The curvature of a hyperedge is the sum over its edges in the poset graph, without making a row for each. A hyperedge of one node is below the
    same members as its vertex, so a vertex stands for itself and all of them, with weight w. With n the member's weighted degree, the sum of
    4 - n - m + 3 tri over neighbours of degrees m is n (4 - n), less the sum of m, and 6 for each triangle that holds the member.
    """
    of_edges, open_, single = _hasse(inc)
    from_nodes, from_edges = _chains(of_edges, open_)
    two_nodes = cut(from_nodes.select("node", F.col("k").alias("edge")).distinct(), "two-step")
    linked = of_edges.select("low", "high").unionByName(from_edges.select(F.col("i").alias("low"), F.col("k").alias("high")).distinct())
    linked = linked.select(F.col("low").alias("edge"), F.col("high").alias("other")).unionByName(linked.select(F.col("high").alias("edge"), F.col("low").alias("other")))
    above = open_.select(F.explode("nodes").alias("node")).unionByName(two_nodes.select("node")).groupBy("node").agg(F.count("*").alias("m"))
    atoms = cut(above.join(single.groupBy("node").agg(F.count("*").alias("singles")), "node", "left").select("node", "m", (1 + F.coalesce("singles", F.lit(0))).alias("w")), "atoms")
    atoms = F.broadcast(atoms) if small(atoms, 64) else atoms
    zero = F.lit(0).cast("long")
    below = open_.select("edge", "card", F.explode_outer("nodes").alias("node")).unionByName(two_nodes.select("edge", F.lit(None).cast("int").alias("card"), "node")).join(atoms, "node", "left")
    rows = below.groupBy("edge").agg(F.max("card").alias("card"), F.sum(F.coalesce("w", zero)).alias("n"), F.sum(F.coalesce(F.col("w") * F.col("m"), zero)).alias("s")).withColumn("t", zero)

    def more(df: DataFrame, n: Column, t: Column) -> DataFrame:
        return df.groupBy("edge").agg(n.alias("n"), t.alias("t")).select("edge", F.lit(None).cast("int").alias("card"), "n", zero.alias("s"), "t")

    rows = rows.unionByName(more(linked, F.count("*"), F.min(zero)))
    rows = rows.unionByName(more(from_nodes.join(atoms, "node").select(F.explode(F.array("j", "k")).alias("edge"), "w"), F.min(zero), F.sum("w")))
    rows = rows.unionByName(more(from_edges.select(F.explode(F.array("i", "j", "k")).alias("edge")), F.min(zero), F.count("*")))
    sums = cut(rows.groupBy("edge").agg(F.max("card").alias("card"), *[F.sum(c).alias(c) for c in "nst"]), "sums")
    near = linked.join(sums.select(F.col("edge").alias("other"), "n"), "other").groupBy("edge").agg(F.sum("n").alias("more"))
    value = F.col("n") * (4 - F.col("n")) - F.col("s") - F.coalesce("more", zero) + 6 * F.col("t")
    return sums.join(near, "edge", "left").select("edge", "card", value.alias("curvature")), open_, two_nodes


def forman_hyperedges(inc: DataFrame, curved: DataFrame | None = None) -> DataFrame:
    """(edge, curvature) of hyperedges with at least two nodes; others have no place above a vertex."""
    if curved is None:
        return forman_sums(inc)[0].select("edge", "curvature")
    cards = inc.groupBy("edge").agg(F.count("*").alias("card")).filter("card > 1")
    sums = forman_nodes(curved).filter(~is_vertex("member")).select(F.shiftright("member", 1).alias("edge"), "curvature")
    return cards.select("edge").join(sums, "edge", "left").select("edge", F.coalesce("curvature", F.lit(0)).alias("curvature"))


def forman_vertices(inc: DataFrame, curved: DataFrame | None = None) -> DataFrame:
    """(node, curvature): the sum of the curvatures of a vertex's neighbours in the poset graph (two-step ones too)."""
    if curved is None:
        sums, open_, two_nodes = forman_sums(inc)
        sums = cut(sums.select("edge", "curvature"), "forman")
        near = open_.join(sums, "edge").select(F.explode("nodes").alias("node"), "curvature").unionByName(two_nodes.join(sums, "edge").select("node", "curvature"))
    else:
        sums = forman_nodes(curved)
        near = curved.filter(is_vertex("u")).select(F.shiftright("u", 1).alias("node"), F.col("v").alias("member")).join(sums, "member")
    out = near.groupBy("node").agg(F.sum("curvature").alias("curvature"))
    return inc.select("node").distinct().join(out, "node", "left").select("node", F.coalesce("curvature", F.lit(0)).alias("curvature"))


def edges_without(inc: DataFrame, removed: DataFrame) -> DataFrame:
    """without_members() of a hypergraph's poset for removed(edge), hyperedges of at least two nodes.

    Triangles are counted once for a vertex and all hyperedges of that node alone; rows are made of these at the end.
    """
    of_edges, open_, single = _hasse(inc)
    gone = cut(removed.select("edge").distinct(), "gone")

    def kept(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.join(gone.select(F.col("edge").alias(c)), c, "left_anti")
        return df

    from_nodes, from_edges = _chains(of_edges, open_)
    mark = gone.select(F.col("edge").alias("j"), F.lit(0).alias("stays"))
    chain_nodes, chain_edges = (cut(kept(df, *ends).join(mark, "j", "left").withColumn("stays", F.coalesce("stays", F.lit(1)).cast("long")), "chains") for df, ends in ((from_nodes, "k"), (from_edges, "ik")))
    weight = single.groupBy("node").agg(F.count("*").alias("singles"))
    weighed = chain_nodes.filter("stays = 1").join(F.broadcast(weight) if small(weight, 64) else weight, "node", "left").select(F.col("j").alias("low"), F.col("k").alias("high"), (1 + F.coalesce("singles", F.lit(0))).alias("tri"))
    sides = [(a, b) for a, b in ("ij", "jk", "ik")]
    whole = chain_edges.filter("stays = 1")
    counts = weighed.unionByName(kept(of_edges, "low", "high").select("low", "high", F.lit(0).cast("long").alias("tri")))
    for a, b in sides[:2]:
        counts = counts.unionByName(whole.select(F.col(a).alias("low"), F.col(b).alias("high"), F.lit(1).cast("long").alias("tri")))
    counts = counts.unionByName(chain_edges.select(F.col("i").alias("low"), F.col("k").alias("high"), F.col("stays").alias("tri")))
    between = counts.groupBy("low", "high").agg(F.sum("tri").alias("tri")).select(hyperedge("low").alias("u"), hyperedge("high").alias("v"), "tri")
    # below a hyperedge, each vertex has a triangle with each hyperedge that covers it
    up = kept(of_edges, "low", "high").groupBy(F.col("low").alias("edge")).agg(F.count("*").alias("tri"))
    below = kept(open_, "edge").join(up, "edge", "left").select(F.explode("nodes").alias("node"), "edge", F.coalesce("tri", F.lit(0)).alias("tri"))
    below = below.unionByName(chain_nodes.groupBy("node", F.col("k").alias("edge")).agg(F.sum("stays").alias("tri")))
    twins = single.groupBy("node").agg(F.collect_list(hyperedge("single")).alias("twins"))
    below = below.join(F.broadcast(twins) if small(single, 64) else twins, "node", "left")
    every = F.concat(F.array(vertex()), F.coalesce("twins", F.array().cast("array<long>")))
    return between.unionByName(below.select(F.explode(every).alias("u"), hyperedge().alias("v"), "tri"))


def without_members(edges: DataFrame, tri: DataFrame, removed: DataFrame) -> DataFrame:
    """poset_edges after removed(member) and all triangles on them are gone; tri: triangles()."""
    gone = removed.select("member").distinct()
    left = tri = cut(tri, "triangles")
    for c in "ijk":
        left = left.join(gone.withColumnRenamed("member", c), c, "left_anti")
    sides = left.select(F.col("i").alias("u"), F.col("j").alias("v")).unionByName(left.select(F.col("j").alias("u"), F.col("k").alias("v"))).unionByName(left.select(F.col("i").alias("u"), F.col("k").alias("v")))
    counts = sides.groupBy("u", "v").agg(F.count("*").alias("tri"))
    kept = edges.select("u", "v")
    for c in "uv":
        kept = kept.join(gone.withColumnRenamed("member", c), c, "left_anti")
    return kept.join(counts, ["u", "v"], "left").select("u", "v", F.coalesce("tri", F.lit(0)).alias("tri"))


def positional(inc: DataFrame, n: int) -> DataFrame:
    """Vertices numbered 1 to n by position: node 0 has no place, and numbers without a node are isolated vertices."""
    return inc.filter(F.col("node").between(1, n))


def forman_vertices_positional(inc: DataFrame, n: int) -> DataFrame:
    """forman_vertices for vertices 1 to n; isolated ones have 0."""
    numbers = inc.sparkSession.range(1, n + 1).select(F.col("id").alias("node"))
    return numbers.join(forman_vertices_keeping(inc, n), "node", "left").select("node", F.coalesce("curvature", F.lit(0)).alias("curvature"))


def forman_vertices_keeping(inc: DataFrame, n: int) -> DataFrame:
    """Vertices outside 1 to n are left out of the poset; hyperedges keep them as members."""
    return forman_vertices(positional(inc, n), cut(forman_edges(poset_edges(covers(inc, F.col("node").between(1, n)))), "forman"))


def edges_with_keys(inc: DataFrame) -> DataFrame:
    """(name, key, card): the bijection between hyperedges in the poset and their nodes, to be read either way."""
    return named(hyperedges(inc).select(hyperedge().alias("name"), "key", "card"), "name")
