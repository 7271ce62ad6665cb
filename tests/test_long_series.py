"""Long series filtered in chunks, and months as keyed state, against whole series and batch queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import filters


def test_a_long_series_in_columns():
    rng = np.random.default_rng(1)
    for order, cutoff in ((5, 1 / 24), (4, 1 / 120), (1, 0.2), (2, 0.4)):
        sections = filters.butterworth(order, cutoff)
        x = np.cumsum(rng.normal(size=5003))
        rest = filters._rest(sections, x[0])
        whole, end = filters._steps(sections, x[:, None], rest[:, None])
        got, state = filters.run_from(sections, x, rest)
        assert np.allclose(got, whole[:, 0], rtol=1e-9, atol=1e-9) and np.allclose(state, end[:, 0], rtol=1e-9, atol=1e-9)
        assert np.allclose(filters._steps(sections, np.full((40, 1), 7.0), filters._rest(sections, 7.0)[:, None])[0], 7.0)


@pytest.mark.parametrize("chunk", [1, 200, 100_000])
def test_chunks_equal_the_whole_series(spark, chunk):
    rng = np.random.default_rng(2)
    lengths = {0: 1000, 1: 67, 2: 3, 3: 1, 4: 413, 5: 20}
    rows = [(k, t + 10 * k, None if k == 5 else float(v)) for k, n in lengths.items() for t, v in enumerate(np.cumsum(rng.normal(size=n)) + 20)]
    df = spark.createDataFrame(rows, "k int, t int, value double").repartition(4)
    got = filters.lowpass_long(df, ["k"], "t", chunk=chunk).toPandas().sort_values(["k", "t"])
    for k, n in lengths.items():
        own, x = got[got.k == k], np.array([v for a, _, v in rows if a == k], float)
        assert own.t.tolist() == [t + 10 * k for t in range(n)]
        if k == 5:
            assert own.value.isna().all()
        elif n > 1:
            assert np.allclose(own.value, filters.zero_phase(x, 5, 1 / 24, 48), rtol=1e-9, atol=1e-8)
        else:
            assert np.allclose(own.value, x)
    with pytest.raises(Exception, match="missing values"):
        filters.lowpass_long(df.where("t != 12"), ["k"], "t").collect()


def test_a_million_samples(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(0).alias("k"), F.col("id").alias("t"), (F.sin(F.col("id") / 300) + (F.col("id") * 7919 % 1000) / 1000).alias("value"))
    got = filters.lowpass_long(df, ["k"], "t", cutoff=1 / 240).orderBy("t").toPandas()["value"].to_numpy()
    t = np.arange(n)
    x = np.sin(t / 300) + (t * 7919 % 1000) / 1000
    sections, full = filters.butterworth(5, 1 / 240), np.concatenate([x[48:0:-1], x, x[-2:-50:-1]])
    ext = np.concatenate([2 * full[:1] - full[18:0:-1], full, 2 * full[-1:] - full[-2:-20:-1]])
    for _ in range(2):
        ext = filters.run_from(sections, ext, filters._rest(sections, ext[0]))[0][::-1]
    assert len(got) == n and np.allclose(got, ext[66 : 66 + n], rtol=1e-9, atol=1e-9)


def test_months_of_a_stream_equal_the_batch(spark, tmp_path):
    """Rows shuffled over files and late by up to a month, months with holes, missing values, and rows too late to count."""
    from thalweg.operators.aggregates import complete_month_means
    from thalweg.streaming.monthly import monthly_stream, run_to_end

    r = random.Random(9)
    rows = [(k, f"2023-{m:02}-{d:02} {r.randrange(24):02}:00:00", None if r.random() < 0.1 else r.uniform(0, 9)) for k in "ab" for m, n in ((11, 30), (12, 31)) for d in range(1, n + 1) for _ in range(r.randrange(1, 4)) if (k, m, d) != ("b", 12, 7)]
    schema = "k string, ts timestamp, value double"
    df = spark.createDataFrame(rows, "k string, t string, value double").select("k", F.col("t").cast("timestamp").alias("ts"), "value")
    df.repartition(6, F.hash("ts", "value")).write.parquet(f"{tmp_path}/in")
    closing = spark.createDataFrame([("z", "2025-01-01", 1.0)], "k string, t string, value double").select("k", F.col("t").cast("timestamp").alias("ts"), "value")
    run_to_end(spark, f"{tmp_path}/in", schema, closing, lambda s: monthly_stream(s, ["k"], "ts", late="70 days"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(x["k"], str(x["month"])): (round(x["value"], 9), x["days"]) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(x["k"], str(x["month"])[:10]): (round(x["value"], 9), x["days"]) for x in complete_month_means(df, ["k"], "ts").collect()}
    assert got == want and set(want) == {("a", "2023-11-01"), ("a", "2023-12-01"), ("b", "2023-11-01")}
    # The month is given out once: a row behind the watermark changes nothing.
    df.limit(1).write.mode("append").parquet(f"{tmp_path}/in")
    closing = closing.withColumn("ts", F.col("ts") + F.expr("interval 1 day"))
    run_to_end(spark, f"{tmp_path}/in", schema, closing, lambda s: monthly_stream(s, ["k"], "ts", late="70 days"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").where("k != 'z'").count() == 3
