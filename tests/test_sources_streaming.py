import numpy as np
from pyspark.sql import functions as F

from thalweg.sources.readers import named_columns, read_table, register_sources, write_product
from thalweg.streaming.daily import daily_means, run_available


def test_npz_round_trip(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.array([[1.0, np.nan], [3.0, 4.0]]), name=np.array(["t"]))
    register_sources(spark)
    rows = spark.read.format("npz").option("path", f"{tmp_path}/*.npz").load().collect()
    assert {tuple(r["index"]): r["value"] for r in rows} == {(0, 0): 1.0, (0, 1): None, (1, 0): 3.0, (1, 1): 4.0}


def test_parquet_product(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", float("nan")), (2, "b", 2.0)], "k int, var string, value double")
    write_product(df, f"{tmp_path}/p", ["var"], {"value": "Sv"})
    got = read_table(spark, f"{tmp_path}/p", ["k", "value"], F.col("var") == "a")
    assert [tuple(r) for r in got.collect()] == [(1, None)]
    assert named_columns(df, {"key": ("q", "k")}).columns[0] == "key"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    run_available(daily_means(stream, ["event_type"], "ts", "value", "0 seconds"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r["event_type"], r["day"]): round(r["value"], 9) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["event_type"], r["day"]): round(r["value"], 9) for r in daily_means(events, ["event_type"], "ts", "value").collect()}
    last = max(d for _, d in want)
    assert {k: v for k, v in want.items() if k[1] < last} == {k: v for k, v in got.items() if k[1] < last}
