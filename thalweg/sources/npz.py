"""NPZ files as a data source: slabs of arrays by byte range, and a sink that is all there or not at all."""

from __future__ import annotations

import fnmatch
import json
import struct
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

#: Values in a batch, and steps of the first axis in a slab.  Slabs of a file share a partition of up to so many values.
BATCH, CHUNK, SHARED = 1 << 16, 240, 1 << 20
#: Axes that have a column in the slab source; further ones are counted on in the last.
AXES = 3


@dataclass
class Member:
    """An array in a file: where its bytes begin (-1: they are compressed) and how they lie."""

    key: str
    shape: tuple
    dtype: str
    fortran: bool
    offset: int


@dataclass
class Slab:
    """Steps lo to hi of the first axis of an array, or of the sum of several."""

    key: str
    members: list
    lo: int
    hi: int


@dataclass
class Slabs(InputPartition):
    """What a task reads of one file."""

    file: str
    slabs: list


def members_of(f, keys: set | None = None) -> list[Member]:
    """The arrays of numbers in an NPZ file (those with the given names), from its directory and their headers alone."""
    out = []
    with zipfile.ZipFile(f) as z:
        for info in z.infolist():
            key = info.filename.removesuffix(".npy")
            if keys is not None and key not in keys:
                continue
            with z.open(info) as m:
                version = np.lib.format.read_magic(m)
                shape, fortran, dtype = np.lib.format.read_array_header_1_0(m) if version == (1, 0) else np.lib.format.read_array_header_2_0(m)
                header = m.tell()
            if dtype.kind not in "fiub":
                continue
            offset = -1
            if info.compress_type == zipfile.ZIP_STORED and not fortran:
                f.seek(info.header_offset + 26)
                name, extra = struct.unpack("<HH", f.read(4))
                offset = info.header_offset + 30 + name + extra + header
            out.append(Member(key, shape, dtype.str, fortran, offset))
    return out


def read_slab(f, member: Member, lo: int, hi: int, second: tuple[int, int] | None = None) -> np.ndarray:
    """Steps lo to hi (not included) of the first axis and, if asked for, second[0] to second[1] of the second, as doubles.

    Only the bytes of the slab are read, one run for each step where the second axis is cut.  Compressed arrays and those in
    column order are read whole.
    """
    shape = member.shape if member.shape else (1,)
    if member.offset < 0:
        f.seek(0)
        with zipfile.ZipFile(f) as z, z.open(f"{member.key}.npy") as m:
            whole = np.lib.format.read_array(m, allow_pickle=False).reshape(shape)
        out = whole[lo:hi]
        return (out if second is None else out[:, second[0] : second[1]]).astype(float)
    dtype = np.dtype(member.dtype)
    step = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
    if second is None:
        f.seek(member.offset + lo * step)
        return np.frombuffer(f.read((hi - lo) * step), dtype).reshape(hi - lo, *shape[1:]).astype(float)
    inner, rows = step // shape[1], []
    for i in range(lo, hi):
        f.seek(member.offset + i * step + second[0] * inner)
        rows.append(f.read((second[1] - second[0]) * inner))
    return np.frombuffer(b"".join(rows), dtype).reshape(hi - lo, second[1] - second[0], *shape[2:]).astype(float)


class NpzReader(DataSourceReader):
    """Tasks by (file, array, CHUNK steps of the first axis), small ones of a file together.  Options: path (a glob in one folder), keys (comma list), sums
    (``total=a+b``: an array added up from others of its file while they are read), chunk."""

    def __init__(self, options: dict, nested: bool):
        self.path, self.nested = options["path"], nested
        self.chunk = int(options.get("chunk", CHUNK))
        self.keys = {k for k in options.get("keys", "").split(",") if k} or None
        self.sums = {k.strip(): [p.strip() for p in v.split("+")] for k, _, v in (s.partition("=") for s in options.get("sums", "").split(",") if s)}
        self.low, self.high = [0] * AXES, [None] * AXES

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Arrays by name and ranges of axes are read no further; everything else is left to Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            axis = int(name[1]) if not self.nested and name in [f"i{k}" for k in range(AXES)] else None
            if name == "key" and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = wanted if self.keys is None else self.keys & wanted
            elif axis is not None and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low[axis] = max(self.low[axis], f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high[axis] = end if self.high[axis] is None else min(self.high[axis], end)
            else:
                yield f

    def _bound(self, axis: int) -> bool:
        return self.low[axis] > 0 or self.high[axis] is not None

    def partitions(self) -> list[InputPartition]:
        base, _, pattern = self.path.rpartition("/")
        system, folder = fs.FileSystem.from_uri(base)
        out, held = [], 0
        for path in sorted(x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern)):
            wanted = None if self.keys is None else {p for k in self.keys for p in self.sums.get(k, [k])}
            with system.open_input_file(path) as f:
                found = {m.key: m for m in members_of(f, wanted)}
            arrays = {k: [found[p] for p in parts] for k, parts in self.sums.items() if all(p in found for p in parts)} | {k: [m] for k, m in found.items()}
            for key in sorted(k for k in arrays if self.keys is None or k in self.keys):
                own, shape = arrays[key], arrays[key][0].shape
                if any(m.shape != shape for m in own):
                    raise ValueError(f"{path}: the arrays of {key} have different shapes")
                if any(self._bound(a) for a in range(len(shape), AXES)) or (self.nested and any(self._bound(a) for a in range(AXES))):
                    continue
                n = shape[0] if shape else 1
                lo, hi = min(self.low[0], n), n if self.high[0] is None else min(n, self.high[0])
                inner = int(np.prod(shape[1:], dtype=np.int64)) if len(shape) > 1 else 1
                for a in range(lo, hi, self.chunk):
                    slab = Slab(key, own, a, min(hi, a + self.chunk))
                    size = (slab.hi - slab.lo) * inner
                    if out and out[-1].file == path and held + size <= SHARED:
                        out[-1].slabs.append(slab)
                        held += size
                    else:
                        out.append(Slabs(path, [slab]))
                        held = size
        return out or [Slabs("", [])]

    def read(self, partition: Slabs) -> Iterator[pa.RecordBatch]:
        if not partition.slabs:
            return
        system, _ = fs.FileSystem.from_uri(self.path.rpartition("/")[0])
        with system.open_input_file(partition.file) as f:
            for slab in partition.slabs:
                yield from self._slab(f, partition.file, slab)

    def _slab(self, f, file: str, wanted: Slab) -> Iterator[pa.RecordBatch]:
        shape = wanted.members[0].shape
        cut = lambda axis, n: (min(self.low[axis], n), n if self.high[axis] is None else max(min(self.high[axis], n), min(self.low[axis], n)))
        second = cut(1, shape[1]) if len(shape) > 1 and self._bound(1) else None
        inner = int(np.prod(shape[1:], dtype=np.int64)) if len(shape) > 1 else 1
        steps = max(1, BATCH // max(1, inner))
        for lo in range(wanted.lo, wanted.hi, steps):
            hi = min(wanted.hi, lo + steps)
            slab = read_slab(f, wanted.members[0], lo, hi, second)
            for m in wanted.members[1:]:
                slab = slab + read_slab(f, m, lo, hi, second)
            yield from self._batches(file, wanted.key, slab, shape, lo, second[0] if second else 0)

    def _batches(self, file: str, key: str, slab: np.ndarray, shape: tuple, first: int, second: int) -> Iterator[pa.RecordBatch]:
        index = np.indices(slab.shape).reshape(slab.ndim, -1) if shape else np.zeros((0, 1), int)
        if len(index):
            index[0] += first
        if len(index) > 1:
            index[1] += second
        values = slab.ravel()
        told = [pa.array([x] * len(values), pa.string()) for x in (file, key)]
        if self.nested:
            places = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(index)), pa.array(index.T.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*told, places, pa.array(values, from_pandas=True)], ["file", "key", "index", "value"])
            return
        if len(index) > AXES:
            index = np.concatenate([index[: AXES - 1], np.ravel_multi_index(tuple(index[AXES - 1 :]), shape[AXES - 1 :])[None]])
        keep = np.ones(len(values), bool)
        if len(index) == AXES and self._bound(2):
            keep = (index[2] >= self.low[2]) & (index[2] < (np.inf if self.high[2] is None else self.high[2]))
        axes = [pa.array(index[a][keep].astype(np.int32)) if a < len(index) else pa.nulls(int(keep.sum()), pa.int32()) for a in range(AXES)]
        yield pa.RecordBatch.from_arrays([*(t.filter(pa.array(keep)) for t in told), *axes, pa.array(values[keep], from_pandas=True)], ["file", "key", "i0", "i1", "i2", "value"])


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (path, file) of each."""

    files: list


class NpzWriter(DataSourceArrowWriter):
    """Rows (file, key, shape, values) to NPZ files in a new folder, with provenance in each; see NpzSource."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.provenance = json.loads(options.get("provenance", "{}"))
        self.temporary = f"{self.path}.tmp-{uuid.uuid4().hex}"

    def _system(self) -> tuple[fs.FileSystem, str, str]:
        system, temporary = fs.FileSystem.from_uri(self.temporary)
        return system, temporary, fs.FileSystem.from_uri(self.path)[1]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Each attempt of a task has a folder of its own, so that one that is repeated leaves no second copy."""
        system, temporary, _ = self._system()
        folder = f"{temporary}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        done, name, out, archive = [], None, None, None

        def close():
            if archive is not None:
                for k, v in sorted(self.provenance.items()):
                    with archive.open(f"{k}.npy", "w") as m:
                        np.lib.format.write_array(m, np.array(v), allow_pickle=False)
                archive.close()
                out.close()

        for batch in iterator:
            for file, key, shape, values in zip(*(batch.column(c) for c in ("file", "key", "shape", "values")), strict=True):
                if file.as_py() != name:
                    close()
                    name = file.as_py()
                    if name in [n for _, n in done]:
                        raise ValueError(f"rows of {name} are not together")
                    done.append((f"{folder}/{name}.npz", name))
                    out = system.open_output_stream(done[-1][0])
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                array = values.values.to_numpy(zero_copy_only=False).astype(float) if values.is_valid else np.zeros(0)
                with archive.open(f"{key.as_py()}.npy", "w", force_zip64=True) as m:
                    np.lib.format.write_array(m, array.reshape(shape.as_py()), allow_pickle=False)
        close()
        return Written(done)

    def commit(self, messages: list) -> None:
        """Files of the tasks that count are put together in one folder, which then gets its name."""
        system, temporary, final = self._system()
        files = [x for m in messages if m is not None for x in m.files]
        names = [name for _, name in files]
        exists = system.get_file_info(final).type != fs.FileType.NotFound
        if len(set(names)) < len(names) or (exists and not self.overwrite):
            self.abort(messages)
            raise ValueError(f"{self.path} is there already" if exists and not self.overwrite else "rows of a file are in several partitions")
        system.create_dir(f"{temporary}/done", recursive=True)
        for path, name in files:
            system.move(path, f"{temporary}/done/{name}.npz")
        if exists:
            system.delete_dir(final)
        system.move(f"{temporary}/done", final)
        system.delete_dir(temporary)

    def abort(self, messages: list) -> None:
        system, temporary, _ = self._system()
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_dir(temporary)


class NpzSource(DataSource):
    """``format("npz")``: arrays of NPZ files as (file, key, index, value) rows, NaN being null, and a sink.

    The sink takes (file, key, shape array<int>, values array<double>), the rows of a file together in one partition, and
    the options path (a new folder) and provenance (a JSON object, put as arrays into every file).  The folder appears when
    all files are there; mode append refuses one that exists, overwrite replaces it.
    """

    nested = True

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "file string, key string, index array<int>, value double"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return NpzReader(self.options, self.nested)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NpzWriter(self.options, overwrite)


class NpzSlabSource(NpzSource):
    """``format("npz_slabs")``: (file, key, i0, i1, i2, value); filters on key and the axes decide which bytes are read."""

    nested = False

    @classmethod
    def name(cls) -> str:
        return "npz_slabs"

    def schema(self) -> str:
        return "file string, key string, i0 int, i1 int, i2 int, value double"


def register_sources(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpzSource)
    spark.dataSource.register(NpzSlabSource)
