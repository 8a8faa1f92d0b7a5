"""Evaluation: partitions, correlations, rank tests, and removal curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperweft.plans.storage import mean_ranks, running_sum

NAN = float("nan")


def contingency(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n)."""
    return labels.groupBy(a, b).agg(F.count("*").alias("n"))


def crosstab(labels: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """The contingency table as one row for each a and one column for each of b's values, with totals."""
    table = labels.groupBy(a).pivot(b, values).count()
    cols = [F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"c_{v}") for v in values]
    out = table.select(F.col(a).cast("string").alias(a), *cols)
    out = out.withColumn("total", sum((F.col(f"c_{v}") for v in values), F.lit(0)))
    sums = out.agg(*[F.sum(c).alias(c) for c in out.columns[1:]]).select(F.lit("total").alias(a), *out.columns[1:])
    return out.unionByName(sums)


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def partition_agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: nmi (arithmetic mean), ari, purity, inverse_purity, homogeneity, completeness, v_measure of assignment a against truth b."""
    cells = contingency(labels, a, b)
    pairs = lambda x: x * (x - 1) / 2
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias("n"), F.max("n").alias("top")) for c in (a, b))
    s = cells.agg(F.sum("n").cast("double").alias("n"), F.sum(_xlogx(F.col("n").cast("double"))).alias("xx"), F.sum(pairs(F.col("n").cast("double"))).alias("pp"))
    r, c = (t.agg(F.sum(_xlogx(F.col("n").cast("double"))).alias(f"{k}x"), F.sum(pairs(F.col("n").cast("double"))).alias(f"{k}p"), F.sum("top").cast("double").alias(f"{k}t")) for k, t in (("r", rows), ("c", cols)))
    one = s.join(F.broadcast(r)).join(F.broadcast(c))  # one row each
    n, log_n = F.col("n"), F.log("n")
    ha, hb, hab = log_n - F.col("rx") / n, log_n - F.col("cx") / n, log_n - F.col("xx") / n
    mutual = ha + hb - hab
    expected = F.coalesce(F.col("rp") * F.col("cp") / F.nullif(pairs(n), F.lit(0.0)), F.lit(0.0))
    best = (F.col("rp") + F.col("cp")) / 2
    ratio = lambda x, y: F.when(y.isNull() | (F.abs(y) < 1e-15), F.lit(1.0)).otherwise(x / y)
    one = one.select(
        ratio(mutual, (ha + hb) / 2).alias("nmi"), ratio(F.col("pp") - expected, best - expected).alias("ari"), (F.col("rt") / n).alias("purity"), (F.col("ct") / n).alias("inverse_purity"),
        ratio(mutual, hb).alias("homogeneity"), ratio(mutual, ha).alias("completeness"),
    )
    h, k = F.col("homogeneity"), F.col("completeness")
    return one.withColumn("v_measure", F.when(h + k > 0, 2 * h * k / (h + k)).otherwise(0.0))


def dense_labels(assignment: DataFrame, n: int) -> DataFrame:
    """(node, label) for nodes 1 to n; '' where there is none. Node 0 has no place in it."""
    nodes = assignment.sparkSession.range(1, n + 1).select(F.col("id").alias("node"))
    return nodes.join(assignment.select("node", F.col("label").cast("string").alias("label")), "node", "left").select("node", F.coalesce("label", F.lit("")).alias("label"))


def letter_label(k: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA, up to 701 (ZZ); null beyond."""
    letter = lambda x: F.char((x + 65).cast("int"))
    return F.when(k < 26, letter(k)).when(k < 702, F.concat(letter(F.floor(k / 26) - 1), letter(k % 26)))


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a NaN or null in columns."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def _corr(a: str, b: str, least: int) -> Column:
    flat = (F.max(a) == F.min(a)) | (F.max(b) == F.min(b)) | (F.count("*") < least)
    return F.when(flat, F.lit(NAN)).otherwise(F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def correlation(df: DataFrame, a: str, b: str, by: list[str] | None = None, least: int = 3, ranks: bool = True) -> DataFrame:
    """(by..., n, pearson, spearman) of finite pairs; NaN for fewer than `least` pairs or a constant side. Without ranks there is no spearman."""
    by = by or []
    df = finite(df.select(*by, F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b")), "__a", "__b")
    if not ranks:
        return df.groupBy(*by).agg(F.count("*").alias("n"), _corr("__a", "__b", least).alias("pearson"))
    ranked = mean_ranks(mean_ranks(df, "__a", "__ra", by), "__b", "__rb", by)
    grouped = ranked.groupBy(*by) if by else ranked.groupBy()
    return grouped.agg(F.count("*").alias("n"), _corr("__a", "__b", least).alias("pearson"), _corr("__ra", "__rb", least).alias("spearman"))


def weighted_mean(strata: DataFrame, value: str) -> DataFrame:
    """One row: the mean of value over strata, weighted by n, without NaN."""
    return finite(strata, value).agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias(value))


def correlation_summary(df: DataFrame, a: str, b: str, stratum: str) -> DataFrame:
    """(scope, n, pearson, spearman): pooled, each stratum, and the n-weighted mean of strata."""
    pooled = correlation(df, a, b).select(F.lit("pooled").alias("scope"), "n", "pearson", "spearman")
    strata = correlation(df, a, b, [stratum])
    named = strata.select(F.concat(F.lit("card "), F.col(stratum)).alias("scope"), "n", "pearson", "spearman")
    mean = lambda c: F.sum(F.when(~F.isnan(c), F.col(c) * F.col("n"))) / F.sum(F.when(~F.isnan(c), F.col("n")))
    weighted = strata.agg(F.sum("n").alias("n"), mean("pearson").alias("pearson"), mean("spearman").alias("spearman")).select(F.lit("weighted").alias("scope"), "n", "pearson", "spearman")
    return pooled.unionByName(named).unionByName(weighted)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, pearson, spearman) of all pairs of columns."""
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            part = correlation(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "pearson", "spearman")
            out = part if out is None else out.unionByName(part)
    return out


def joined_curvatures(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b) of two (key, value) tables. Where keys are missing or repeat and both have one length, rows are joined by position `pos` instead."""
    usable = all(t.filter("key is null").isEmpty() and t.groupBy("key").count().filter("count > 1").isEmpty() for t in (a, b))
    if usable:
        return a.select("key", F.col("value").alias("a")).join(b.select("key", F.col("value").alias("b")), "key")
    if a.count() != b.count():
        raise ValueError("keys can't be matched, and the tables differ in length")
    return a.select("key", F.col("value").alias("a"), "pos").join(b.select(F.col("value").alias("b"), "pos"), "pos").select("key", "a", "b")


def aligned(tables: dict[str, DataFrame]) -> DataFrame:
    """Inner join of (key, value) tables on key; one column for each."""
    out = None
    for name, t in tables.items():
        t = t.select("key", F.col("value").alias(name))
        out = t if out is None else out.join(t, "key")
    return out


def normal_tail(z: Column) -> Column:
    """P(Z > z): the series of the error function for small z, the continued fraction of its complement beyond."""
    x = F.abs(z) / math.sqrt(2)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda acc, k: F.struct((-acc["term"] * x * x / k).alias("term"), (acc["total"] - acc["term"] * x * x / k / (2 * k + 1)).alias("total")),
        lambda acc: acc["total"],
    )
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / 2 / acc)
    tail = F.when(x < 2.0, 1 - 2 / math.sqrt(math.pi) * series).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / fraction) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def mann_whitney(df: DataFrame, value: str, group: str, by: list[str] | None = None, least: int = 3) -> DataFrame:
    """(by..., n1, n2, u, r, z, p): one-sided test that `value` is greater where group is true.

    Normal approximation with ties and continuity correction; r = 2U/(n1 n2) - 1 is the rank-biserial correlation. All are NaN
    where a group has fewer than `least` values.
    """
    by = by or []
    df = finite(df.select(*by, F.col(value).cast("double").alias("__v"), F.col(group).cast("boolean").alias("__g")), "__v").filter("__g is not null")
    ranked = mean_ranks(df, "__v", "__r", by)
    ties = df.groupBy(*by, "__v").agg(F.count("*").cast("double").alias("t"))
    t = (ties.groupBy(*by) if by else ties.groupBy()).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    s = (ranked.groupBy(*by) if by else ranked.groupBy()).agg(F.sum(F.col("__g").cast("long")).alias("n1"), F.sum((~F.col("__g")).cast("long")).alias("n2"), F.sum(F.when(F.col("__g"), F.col("__r")).otherwise(0.0)).alias("sum1"))
    s = s.join(t, by) if by else s.join(F.broadcast(t))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    enough = (n1 >= least) & (n2 >= least)
    u = F.col("sum1") - n1 * (n1 + 1) / 2
    sd = F.coalesce(F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0)))), F.lit(0.0))
    z = F.when(sd > 0, (u - n1 * n2 / 2 - 0.5) / sd).otherwise(NAN)
    out = s.select(*by, "n1", "n2", F.when(enough, u).otherwise(NAN).alias("u"), F.when(enough, 2 * u / (n1 * n2) - 1).otherwise(NAN).alias("r"), F.when(enough, z).otherwise(NAN).alias("z"))
    return out.withColumn("p", F.when(F.isnan("z"), F.lit(NAN)).otherwise(normal_tail(F.col("z"))))


def holm(df: DataFrame, p: str = "p", key: str = "key") -> DataFrame:
    """Add p_holm, the Holm-Bonferroni adjusted p; NaN passes through. One row for each test, so a plain window serves."""
    ok = ~F.isnan(p)
    rank = F.row_number().over(Window.partitionBy(ok).orderBy(p, key))
    m = F.count("*").over(Window.partitionBy(ok))
    running = F.max(F.least(F.lit(1.0), (m - rank + 1) * F.col(p))).over(Window.partitionBy(ok).orderBy(p, key).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("p_holm", F.when(ok, running).otherwise(NAN))


def label_counts(inc: DataFrame, labels: DataFrame) -> DataFrame:
    """(edge, card, labelled, top, second, n_labels, label): how a hyperedge's nodes are spread over labels(node, label); top is the largest count, label its label."""
    cards = inc.groupBy("edge").agg(F.count("*").alias("card"))
    counts = inc.join(labels, "node").groupBy("edge", "label").agg(F.count("*").alias("c"))
    ranked = counts.groupBy("edge").agg(F.sum("c").alias("labelled"), F.max("c").alias("top"), F.count("*").alias("n_labels"), F.sort_array(F.collect_list("c"), asc=False).alias("cs"), F.max_by("label", F.struct("c", F.col("label"))).alias("label"))
    out = cards.join(ranked, "edge", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("edge", "card", zero("labelled"), zero("top"), F.coalesce(F.get("cs", F.lit(1)), F.lit(0)).alias("second"), zero("n_labels"), "label")


def within(counts: DataFrame, rule: str) -> DataFrame:
    """(edge, within) of label_counts().

    strict, majority: all nodes, or more than half of them, have one label; nodes without a label count in the size.
    linear: one label has the most nodes; null on a tie. unassigned_strict, unassigned_majority: as the first two, but nodes
    without a label are ignored; a hyperedge without labels isn't within. impure: more than one label, or none.
    """
    c, n, top = F.col("card"), F.col("labelled"), F.col("top")
    rules = {
        "strict": top == c,
        "majority": top > c / 2,
        "linear": F.when(n == 0, False).when(top == F.col("second"), F.lit(None).cast("boolean")).otherwise(True),
        "unassigned_strict": (n > 0) & (top == n),
        "unassigned_majority": (n > 0) & (top > n / 2),
        "impure": F.col("n_labels") == 1,
    }
    return counts.select("edge", rules[rule].alias("within"))


def grouped_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, mean, median, std)."""
    return finite(df, value).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"))


def summary(df: DataFrame, value: str) -> DataFrame:
    """One row: n, n_nan, least, median, mean, greatest, std."""
    ok = F.when(~F.isnan(value), F.col(value))
    return df.agg(F.count("*").alias("n"), F.sum(F.isnan(value).cast("long")).alias("n_nan"), F.min(ok).alias("least"), F.median(ok).alias("median"), F.avg(ok).alias("mean"), F.max(ok).alias("greatest"), F.stddev_samp(ok).alias("std"))


def integer_histogram(df: DataFrame, value: str, width: int = 1) -> DataFrame:
    """(bin, n): counts of bins [bin, bin + width) aligned to multiples of width."""
    return finite(df, value).groupBy((F.floor(F.col(value) / width) * width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, n): `bins` equal bins from the least to the greatest value; the last one is closed."""
    df = finite(df, value)
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    j = df.join(F.broadcast(ends))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    return j.groupBy(at.cast("int").alias("bin"), "lo", "hi").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("low"), "n")


def removal_curve(order: DataFrame, between: DataFrame, steps: int | None = None) -> DataFrame:
    """(step, removed_between, precision, recall) of order(step, edge): how far the first removals are between-cluster hyperedges of between(edge, is_between)."""
    j = order.join(between, "edge").withColumn("__b", F.coalesce(F.col("is_between").cast("long"), F.lit(0)))
    total = j.agg(F.sum("__b").alias("__all"))
    if steps is not None:
        j = j.filter(F.col("step") <= steps)
    run = running_sum(j, [F.col("step")], F.col("__b"), "removed_between").join(F.broadcast(total))
    return run.select("step", "edge", F.col("removed_between").cast("long").alias("removed_between"), (F.col("removed_between") / F.col("step")).alias("precision"), F.when(F.col("__all") > 0, F.col("removed_between") / F.col("__all")).otherwise(0.0).alias("recall"))


def compare_removals(orders: dict[str, DataFrame], between: DataFrame, steps: int | None = None) -> DataFrame:
    """removal_curve() of several removal orders, with their names in `source`."""
    out = None
    for name, order in orders.items():
        part = removal_curve(order, between, steps).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def sweep(curvature, inc: DataFrame, settings: dict[str, dict]) -> DataFrame:
    """(setting, ...) of curvature(inc, **options) for each of several named options: for comparisons of solvers and regularisations."""
    out = None
    for name, options in settings.items():
        part = curvature(inc, **options).withColumn("setting", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
