"""NPZ files: slabs by byte range, pushed filters, sums, and a sink that is all there or not at all."""

import io
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thalweg.sources import npz


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


@pytest.fixture(scope="module")
def arrays():
    r = np.random.default_rng(1)
    return {"u": r.normal(size=(500, 6, 40)), "v": r.normal(size=(500, 6, 40)), "flat": np.arange(7), "one": np.array(3.5), "name": np.array(["x"]), "column": np.asfortranarray(r.normal(size=(9, 4))), "four": np.arange(120).reshape(5, 2, 3, 4)}


def test_only_the_bytes_of_a_slab_are_read(arrays):
    out = io.BytesIO()
    np.savez(out, **arrays)
    f = Counting(out.getvalue())
    members = {m.key: m for m in npz.members_of(f)}
    assert set(members) == set(arrays) - {"name"} and f.taken < 60_000 < len(out.getvalue()) // 10
    f.taken = 0
    assert (npz.read_slab(f, members["u"], 100, 110) == arrays["u"][100:110]).all() and f.taken == 10 * 6 * 40 * 8
    f.taken = 0
    assert (npz.read_slab(f, members["v"], 100, 110, (2, 3)) == arrays["v"][100:110, 2:3]).all() and f.taken == 10 * 40 * 8
    assert members["column"].offset == -1 and (npz.read_slab(f, members["column"], 2, 5) == arrays["column"][2:5]).all()
    packed = io.BytesIO()
    np.savez_compressed(packed, **arrays)
    m = {m.key: m for m in npz.members_of(packed)}["u"]
    assert m.offset == -1 and (npz.read_slab(packed, m, 3, 9, (1, 4)) == arrays["u"][3:9, 1:4]).all()


def test_filters_are_pushed_and_sums_made(spark, tmp_path, arrays):
    arrays = arrays | {"hole": np.where(arrays["u"] > 2, np.nan, arrays["u"])}
    np.savez(tmp_path / "a.npz", **arrays)
    npz.register_sources(spark)
    read = lambda **o: spark.read.format("npz_slabs").options(path=f"{tmp_path}/*.npz", chunk=64, **o).load()
    slab = read(sums="w=u+v").where(F.col("key").isin("w", "hole") & (F.col("i0") >= 60) & (F.col("i0") < 70) & (F.col("i1") == 4) & (F.col("i2") > 30))
    got = {(r["key"], r["i0"], r["i1"], r["i2"]): r["value"] for r in slab.collect()}
    assert len(got) == 2 * 10 * 9
    for (key, *at), value in got.items():
        want = (arrays["u"] + arrays["v"] if key == "w" else arrays["hole"])[tuple(at)]
        assert value is None if np.isnan(want) else value == want
    plan = slab._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"i[0-2]#\d+ (<|>|=)|key#\d+ IN", plan)
    rest = {(r["key"], r["i0"], r["i1"], r["i2"]): r["value"] for r in read(keys="flat,one,four").collect()}
    assert rest["flat", 3, None, None] == 3 and rest["one", None, None, None] == 3.5 and rest["four", 4, 1, 11] == 119 and len(rest) == 7 + 1 + 120
    assert read().where("key = 'nothing'").count() == 0 and read().where("i1 = 99 AND key = 'u'").count() == 0
    assert read().where("i0 > 495 AND i0 <= 498").groupBy("key").count().count() == 3


def rows(file, key, values):
    return pa.RecordBatch.from_pydict({"file": [file] * len(key), "key": key, "shape": [[len(v)] for v in values], "values": values})


def test_a_repeated_task_leaves_no_second_copy(tmp_path):
    path = f"{tmp_path}/out"
    writer = npz.NpzWriter({"path": path, "provenance": '{"source": "test"}'}, False)
    batch = rows("a", ["x", "y"], [[1.0, None], [3.0]])
    writer.write(iter([batch]))  # this attempt is lost after it has written
    with pytest.raises(RuntimeError):
        def broken():
            yield batch
            raise RuntimeError
        writer.write(broken())
    good = writer.write(iter([batch])), writer.write(iter([rows("b", ["x"], [[7.0]])]))
    assert not (tmp_path / "out").exists()
    writer.commit(list(good))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.npz", "b.npz"] and len(list(tmp_path.iterdir())) == 1
    with np.load(f"{path}/a.npz") as data:
        assert np.isnan(data["x"][1]) and data["y"][0] == 3.0 and str(data["source"]) == "test"
    again = npz.NpzWriter({"path": path}, False)
    with pytest.raises(ValueError, match="already"):
        again.commit([again.write(iter([batch]))])
    twice = npz.NpzWriter({"path": path}, True)
    with pytest.raises(ValueError, match="several"):
        twice.commit([twice.write(iter([batch])), twice.write(iter([batch]))])
    assert len(list(tmp_path.iterdir())) == 1 and len(list((tmp_path / "out").iterdir())) == 2
    other = npz.NpzWriter({"path": path}, True)
    other.commit([other.write(iter([rows("c", ["x"], [[1.0]])]))])
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["c.npz"]


def test_sink_and_source_through_spark(spark, tmp_path):
    npz.register_sources(spark)
    df = spark.createDataFrame([(f"f{i % 3}", f"k{i}", [2, 2], [float(i), None, 1.0, 2.0]) for i in range(12)], "file string, key string, shape array<int>, values array<double>")
    df.repartition(2, "file").sortWithinPartitions("file").write.format("npz").mode("append").option("path", f"{tmp_path}/p").save()
    got = {(r["key"], tuple(r["index"])): r["value"] for r in spark.read.format("npz").option("path", f"{tmp_path}/p/*.npz").load().collect()}
    assert len(got) == 48 and got["k5", (0, 0)] == 5.0 and got["k5", (0, 1)] is None and got["k5", (1, 1)] == 2.0
    with pytest.raises(Exception, match="not together|several"):
        df.coalesce(1).sortWithinPartitions("key").write.format("npz").mode("append").option("path", f"{tmp_path}/q").save()
    assert not (tmp_path / "q").exists()
