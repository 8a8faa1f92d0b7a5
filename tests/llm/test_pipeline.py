"""The pipeline against a plain version of itself on a small table, and the driver's tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import make_docs, plain_near  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in make_docs(4) if r[0] is not None and r[0] != 3]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] < 50], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    item = " ".join(next(r[1] for r in rows if r[0] == 11).split()[:30])
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = out.cache()
        sizes.append(docs.count())
    # nothing is toxic here
    assert sizes[1] == sizes[0]
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found, _ = plain_near(rows)
    ids = {v[0] for v in found.values() if v[3]} | {r[0] for r in rows if not (r[1] or "").split()}
    near = corpus_pipeline.STAGES[1][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert {r["doc_id"] for r in near.collect()} == ids
    assert 11 not in {r["doc_id"] for r in docs.collect()}
    assert sizes[4] >= sizes[3]


def test_run_returns_token_ids(spark, folder):
    out = sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: r["start"])
    start = 0
    for r in out:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out)


def test_extra_columns_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS toxicity", "2 AS `class`", "3 AS h", "4 AS item_id", "'q' AS word")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    assert docs.columns[-5:] == ["toxicity", "class", "h", "item_id", "word"] and docs.count() > 0
