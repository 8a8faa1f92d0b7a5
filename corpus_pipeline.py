"""The corpus pipeline: documents in, packed token ids out, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is all that the stage before it kept, and returns a DataFrame
that is written as Parquet and read again as the next stage's docs. All but the last return the columns of
documents.

    toxicity          documents that score 0.7 or more go
    near_duplicates   one document of each group of near-duplicates or copies stays
    decontamination   documents that hold a benchmark item go
    mixing            documents are repeated so that the languages' tokens match the target weights
    token_ids         what is left, as packed token ids read back from the files
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweft.llm import decontam, mixing, nearjoin, tokens, toxicity
from hyperweft.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, row by row; null and empty texts score the model's bias. Without labels nothing goes."""
    params = toxicity.ToxicityParams()
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")), params)
    return toxicity.score(docs, model, params, "__hw_toxicity").filter(F.col("__hw_toxicity") < params.threshold).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates or copies, that with the smallest doc_id; texts without words all stay."""
    return nearjoin.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts stay, and all do if there are no items."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, by languages that the labelled documents teach; empty tables give no rows."""
    return mixing.mixed_documents(docs, mixing.lang_labels(docs, table(spark, sf_dir, "labels")))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, packed into shards and read back: a row for each row of docs, in the order of doc_id (null first)."""
    return tokens.op2_token_ids(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_languages),
    ("token_ids", write_token_ids),
]

#: The classifier, the fitted rates and the tokenizer have no SQL form; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
