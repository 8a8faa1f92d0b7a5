"""Streams against batches."""

from hyperweft.operators import incidence
from hyperweft.streaming.incidence import stream_cardinalities, stream_degrees


def test_degrees_of_a_stream(spark, tmp_path):
    rows = [(k % 7, k % 5) for k in range(60)]
    df = spark.createDataFrame(rows, "edge long, node long")
    for k in range(3):
        df.filter(df.edge % 3 == k).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_degrees(stream).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in incidence.degrees(df.distinct()).collect()}
    assert {tuple(r) for r in spark.table("degrees").collect()} == want


def test_cardinalities_plan(spark, tmp_path):
    stream = spark.readStream.schema("edge long, node long, ts timestamp").parquet(str(tmp_path))
    assert stream_cardinalities(stream, "ts").columns == ["window", "edge", "card"]
