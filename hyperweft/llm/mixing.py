"""Mixing sources to target weights by soft membership, in DataFrame operations alone.

1. A labelled table (doc_id, domain) teaches a naive Bayes classifier its words: a bounded sample of
   labelled rows gives the `vocabulary` most frequent words and their log-likelihood in each domain.
2. Every document gets a posterior over the domains from the mean log-likelihood of its known words
   (sharpened by `sharpness`) and the domains' priors; without a known word it is the prior.
3. Document rates r >= 0 are fitted by projected-gradient least squares, so that the expected tokens of
   each domain, sum of r * tokens * posterior, match its target. Each round is one aggregation of a
   narrow table to one number a domain; the step is scaled by each document's tokens and each domain's
   total, which bounds the largest eigenvalue by 1, so that the step 1 always descends.
4. A document is written floor(r) times, and once more with probability r - floor(r), by a hash of its id.

Without `budget`, the tokens of the mix are the fewest for which no domain shrinks, and no document with words gets a rate below 1 (unless
that would double the mix, as posteriors are too soft for the targets): documents are repeated, and none is left out.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperweft.llm.common import id_back, id_key, materialize

# The target weights of the query and the pipeline.
TARGETS = {"de": 0.16, "en": 0.58, "es": 0.11, "fr": 0.15}
NOT_LETTERS = r"[^\p{L}]+"


@dataclass(frozen=True)
class MixParams:
    """rows_per_domain bounds (in expectation, by a hash of doc_id) the labelled rows of each domain that the classifier is fitted on."""

    targets: dict[str, float] = field(default_factory=lambda: dict(TARGETS))
    rows_per_domain: int = 1500
    vocabulary: int = 3000
    sharpness: float = 1.5
    rounds: int = 30
    tolerance: float = 1e-5
    budget: float | None = None
    seed: int = 5


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.explode_outer(F.split(F.lower("text"), NOT_LETTERS)).alias("word"))


def train(docs: DataFrame, labelled: DataFrame, p: MixParams) -> tuple[DataFrame, list[float]]:
    """(word, likelihoods) of at most `vocabulary` words, and the log priors, in the order of sorted(targets)."""
    names = sorted(p.targets)
    marks = labelled.filter(F.col("domain").isin(names) & F.col("doc_id").isNotNull()).select("doc_id", "domain").distinct()
    counts = {r["domain"]: r["count"] for r in marks.groupBy("domain").count().collect()}  # at most one row a domain
    total = sum(counts.values())
    priors = [math.log((counts.get(n, 0) + 1) / (total + len(names))) for n in names]
    share = F.coalesce(*[F.when(F.col("domain") == n, F.lit(p.rows_per_domain / max(1, counts.get(n, 0)))) for n in names])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = marks.filter(draw < share)  # rows_per_domain * domains ids, in expectation
    words = _words(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "domain").filter("word <> ''")
    seen = [F.sum(F.when(F.col("domain") == n, 1).otherwise(0)).alias(f"c{k}") for k, n in enumerate(names)]
    # the same word in one document counts each time
    table = words.groupBy("word").agg(*seen, F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(p.vocabulary)
    table = materialize(table, "vocabulary")
    sums = table.agg(*[F.sum(f"c{k}").alias(f"s{k}") for k in range(len(names))]).first()
    logs = [F.log((F.col(f"c{k}") + 0.5) / F.lit((sums[k] or 0) + 0.5 * p.vocabulary)) for k in range(len(names))]
    return table.select("word", *[x.alias(f"l{k}") for k, x in enumerate(logs)]), priors


def memberships(docs: DataFrame, model: tuple[DataFrame, list[float]], p: MixParams) -> DataFrame:
    """(id, h, n_tokens, p0, p1, ...): one row for each doc_id and text; h is a hash of the text.

    The vocabulary is bounded, so it is broadcast. Words are summed up inside the task that read them;
    the shuffle carries one row a document.
    """
    table, priors = model
    k = range(len(priors))
    words = _words(docs.select(id_key().alias("id"), F.xxhash64("text").alias("h"), "text"), "id", "h")
    known = words.join(F.broadcast(table), "word", "left")
    sums = known.groupBy("id", "h").agg(F.count(F.when(F.col("word") != "", 1)).alias("n_tokens"), F.count("l0").alias("n_known"), *[F.sum(f"l{j}").alias(f"s{j}") for j in k])
    logits = [F.coalesce(p.sharpness * F.col(f"s{j}") / F.col("n_known"), F.lit(0.0)) + F.lit(priors[j]) for j in k]
    scored = sums.select("id", "h", "n_tokens", *[x.alias(f"z{j}") for j, x in enumerate(logits)])
    top = F.greatest(*[F.col(f"z{j}") for j in k]) if len(priors) > 1 else F.col("z0")
    e = scored.select("id", "h", "n_tokens", *[F.exp(F.col(f"z{j}") - top).alias(f"e{j}") for j in k])
    total = sum((F.col(f"e{j}") for j in k), F.lit(0.0))
    return e.select("id", "h", "n_tokens", *[(F.col(f"e{j}") / total).alias(f"p{j}") for j in k])


#: Rounds after which rates are written, so that a round doesn't work out all before it again.
WRITTEN = 8


def fit_rates(members: DataFrame, p: MixParams) -> tuple[DataFrame, list[dict]]:
    """members with `rate`, and the rounds' records: expected tokens and largest relative error, the last one of the rates returned."""
    names = sorted(p.targets)
    k = range(len(names))
    weight = sum(p.targets.values())

    def totals(rated: DataFrame, rate: Column) -> list[float]:
        row = rated.agg(*[F.sum(rate * F.col("n_tokens") * F.col(f"p{j}")).alias(f"t{j}") for j in k]).first()
        return [float(x or 0.0) for x in row]

    rated, rate = members, F.lit(1.0)
    natural = now = totals(rated, rate)
    shares = [p.targets[n] / weight for n in names]
    budget = p.budget if p.budget is not None else max((s / w for s, w in zip(natural, shares, strict=True) if w > 0), default=0.0)
    wanted = [budget * w for w in shares]
    record = []
    for done in range(p.rounds + 1):
        error = max((abs(a - b) / budget for a, b in zip(now, wanted, strict=True)), default=0.0) if budget else 0.0
        record.append({"tokens": now, "wanted": wanted, "error": error})
        if error <= p.tolerance or done == p.rounds:
            break
        step = [(a - b) / n if n > 0 else 0.0 for a, b, n in zip(now, wanted, natural, strict=True)]
        rate = F.greatest(F.lit(0.0), rate - sum((F.lit(step[j]) * F.col(f"p{j}") for j in k), F.lit(0.0)))
        if (done + 1) % WRITTEN == 0:
            rated, rate = materialize(rated.withColumn("rate", rate), "rates"), F.col("rate")
        now = totals(rated, rate)
    rated = rated.withColumn("rate", rate)
    if p.budget is None:
        # soft posteriors can put rates of the scarcest domain a little below 1: all rates rise by one factor, which keeps the shares. Where
        # posteriors are so soft that the mix would more than double, documents are left out
        least = rated.filter("n_tokens > 0").agg(F.min("rate")).first()[0]
        if least is not None and 0.5 <= least < 1:
            rated = rated.withColumn("rate", F.greatest(F.col("rate") / F.lit(least), F.when(F.col("n_tokens") > 0, F.lit(1.0))))
    return rated, record


def mix(docs: DataFrame, labelled: DataFrame, params: MixParams | None = None) -> DataFrame:
    """(id, h, n_tokens, p0, ..., rate, n_copies) of every doc_id and text of docs(doc_id, text).

    labelled(doc_id, domain): rows of unknown domains and null ids are not learned from. A document without
    words has no tokens and the priors as its posterior, and gets a rate like any other. Rows that
    repeat a doc_id and its text share one row. Of words that are equally frequent at the end of the vocabulary the first ones in
    the order of letters are known. Empty tables give no rows. A fit that ends short of its targets warns.
    """
    p = params or MixParams()
    members = materialize(memberships(docs, train(docs, labelled, p), p), "memberships")
    rated, record = fit_rates(members, p)
    if record[-1]["error"] > 0.01:
        warnings.warn(f"rates miss their targets by {record[-1]['error']:.3f} of the budget after {p.rounds} rounds", stacklevel=2)
    draw = F.pmod(F.xxhash64("id", "h", F.lit(p.seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    whole = F.floor("rate")
    return rated.withColumn("n_copies", (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("long"))


def lang_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the query and the pipeline: the language of documents that `labels` holds."""
    return labels.select("doc_id").distinct().join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id").filter("domain is not null")


def op1_mixing(docs: DataFrame, labels: DataFrame, params: MixParams | None = None) -> DataFrame:
    """doc_id, n_tokens, posterior, rate, n_copies: one row for each doc_id and text; rows that repeat both share one. See mix()."""
    p = params or MixParams()
    names = sorted(p.targets)
    mixed = mix(docs, lang_labels(docs, labels), p)
    posterior = F.create_map(*[x for j, n in enumerate(names) for x in (F.lit(n), F.col(f"p{j}"))])
    return mixed.select(id_back(F.col("id")).alias("doc_id"), "n_tokens", posterior.alias("posterior"), "rate", "n_copies")


def mixed_documents(docs: DataFrame, labelled: DataFrame, params: MixParams | None = None) -> DataFrame:
    """Rows of docs, each as often as its copies say, with the columns of docs."""
    mixed = mix(docs, labelled, params).select(F.col("id").alias("__hw_id"), F.col("h").alias("__hw_h"), F.col("n_copies").alias("__hw_n"))
    keyed = docs.withColumn("__hw_id", id_key()).withColumn("__hw_h", F.xxhash64("text"))
    out = keyed.join(mixed.filter("__hw_n > 0"), ["__hw_id", "__hw_h"])
    return out.withColumn("__hw_k", F.explode(F.array_repeat(F.lit(1), F.col("__hw_n").cast("int")))).select(*docs.columns)
