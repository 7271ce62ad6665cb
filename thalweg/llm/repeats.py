"""Removal of every byte that lies in a long string which occurs elsewhere too, exactly and over all documents.

Every window of ``length`` bytes is charged to an anchor: the place of the smallest hash of ``GRAM`` bytes inside it.
Equal windows have equal anchors at equal offsets, so only runs of windows around equal anchors can repeat each other.
A run whose whole content occurs twice is repeated throughout.  Runs that share an anchor with a different content (the
edges of repeated passages) are cut into cells of windows, and cells are told to repeat as a whole, or not at all, from
two hashes.  The cells in between, which are where repeats begin and end, go into blocks by what their windows have in
common, so that equal windows meet.  Each block gets a run-length index (a run-compressed Burrows-Wheeler transform with
sampled run ends), whose matching statistics mark the long matches.  A group of cells that would not fit a block is
compared by grouping the hashes of its windows instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, saved, table
from .hashing import as_bytes, mix
from .runindex import RunIndex, Text

LENGTH = 400
#: Bytes of the strings whose hashes place the anchors.
GRAM = 48
#: Windows in a cell.
CELL = 32
#: Cells in a block of the run-length index, about; groups of more than half as many are compared by hashes of windows.
BLOCK_CELLS = 2048
#: Bytes of cells that a task gathers before it gives them on.
FLUSH = 1 << 23
#: What is shuffled is filtered before by a broadcast set of up to this many keys; beyond it, by joins alone.
FILTER_KEYS = 4_000_000
#: Up to this many marked texts, their keys are broadcast and only they are shuffled.
MARKED_TEXTS = 300_000
_U = np.uint64


def _text_runs(text: Text, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor hash, content hash and anchor of each run of windows with one anchor."""
    if text.n < length:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(_U), none.astype(_U), none
    grams = text.grams(gram)
    width = length - gram + 1
    # A hash and, in the lowest bits, the place in two blocks of `width`, which is as far as any comparison goes: of equal
    # hashes the first is the smallest, however long the text is.
    low = _U((2 * width).bit_length())
    n = len(grams)
    at = np.arange(n + -n % width, dtype=_U) % _U(width)
    key = np.full(len(at), np.iinfo(np.uint64).max, _U)
    key[:n] = (grams >> low << low) | at[:n]
    # The smallest of each `width` keys: of the end of one block and the beginning of the next.
    blocks = key.reshape(-1, width)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    key[:n] += _U(width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    windows = text.n - length + 1
    place = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & ((_U(1) << low) - _U(1))
    anchor = place.astype(np.int64) + np.arange(windows) // width * width
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(first, windows))
    at = anchor[first]
    content = mix(text.hashes(first, first + count - 1 + length) ^ mix((at - first).astype(_U) + _U(0x9E37)))
    return first, count, grams[at], content, at


_GROUPED = "anchor long, content long"
_RUNS = "th binary, first int, count int, anchor long, content long, cells array<struct<off:int,count:int,inner:bigint,outer:bigint>>"
_OPEN = "inner bigint, outer bigint, step int, window bigint, piece binary"
_MARKS = "inner bigint, outer bigint, step int"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(batch, length):
    """(row, text, runs) of the texts that are long enough."""
    data, offsets = as_bytes(batch.column("text"))
    for i in range(len(offsets) - 1):
        if offsets[i + 1] - offsets[i] >= length:
            text = Text(data[offsets[i] : offsets[i + 1]])
            yield i, text, _text_runs(text, length, GRAM)


def _anchors(batches, length):
    """The distinct (anchor, content) pairs of a batch, twice those that it has more than once."""
    for batch in batches:
        found = [(r[2], r[3]) for _, _, r in _texts(batch, length)]
        if found:
            both = np.stack([np.concatenate([x[k] for x in found]) for k in (0, 1)], 1)
            both, n = np.unique(both, axis=0, return_counts=True)
            both = np.concatenate([both, both[n > 1]])
            yield pa.RecordBatch.from_arrays([_signed(both[:, 0].copy()), _signed(both[:, 1].copy())], ["anchor", "content"])


def _among(known: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if known is None:
        return np.ones(len(keys), bool)
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _cells(text: Text, first: np.ndarray, count: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cuts runs into cells of CELL windows by their distance to the anchor ``at``.

    Returns run, first window, windows, inner and outer hash of each cell.  ``inner`` is what all windows of the cell
    have in common, whether the run has them all or not: no window repeats unless it does.  ``outer`` is the content of
    all its windows together: if it repeats, they all do.
    """
    low, high = (at - first - count + 1) // CELL, (at - first) // CELL
    n = high - low + 1
    run = np.repeat(np.arange(len(first)), n)
    c = high[run] - (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n))
    a_high = np.minimum(c * CELL + CELL - 1, (at - first)[run])
    a_low = np.maximum(c * CELL, (at - first - count + 1)[run])
    begin = at[run] - a_high
    size = a_high - a_low + 1
    core = at[run] - c * CELL
    inner = mix(text.hashes(core, core + length - CELL + 1) ^ mix(c.astype(_U) + _U(0xC311)))
    outer = mix(text.hashes(begin, begin + size - 1 + length) ^ mix((a_low * 4096 + a_high).astype(_U) + _U(0xFACE)))
    return run, begin, size, inner, outer


def _runs(batches, length, known):
    for batch in batches:
        anchors, edges = known.value
        th = batch.column("th")
        rows, cols, cells = [], [[], [], [], []], []
        for i, text, (first, count, anchor, content, at) in _texts(batch, length):
            keep = np.flatnonzero(_among(anchors, anchor.view(np.int64)))
            first, count, anchor, content, at = (x[keep] for x in (first, count, anchor, content, at))
            rows += [i] * len(first)
            for out, x in zip(cols, (first, count, anchor.view(np.int64), content.view(np.int64)), strict=True):
                out.append(x)
            own: list = [None] * len(first)
            edge = np.flatnonzero(_among(edges, anchor.view(np.int64)))
            for k in edge.tolist():
                own[k] = []
            run, begin, size, inner, outer = _cells(text, first[edge], count[edge], at[edge], length)
            for r, b, n, x, y in zip(edge[run].tolist(), begin.tolist(), size.tolist(), inner.view(np.int64).tolist(), outer.view(np.int64).tolist(), strict=True):
                own[r].append({"off": b - int(first[r]), "count": n, "inner": x, "outer": y})
            cells += own
        if rows:
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64()
            kind = pa.list_(pa.struct([("off", pa.int32()), ("count", pa.int32()), ("inner", pa.int64()), ("outer", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [th.take(pa.array(rows)), *[pa.array(np.concatenate(x), k) for x, k in zip(cols, kinds, strict=True)], pa.array(cells, kind)],
                ["th", "first", "count", "anchor", "content", "cells"],
            )


def _open_cells(batches, length, known, wanted):
    """The open cells, once for each content and batch: those of small groups as bytes, of large ones window by window."""
    edges, (few, many) = known.value[1], wanted.value
    for batch in batches:
        seen, found, size_found = set(), [], 0
        for _, text, (first, count, anchor, _, at) in _texts(batch, length):
            keep = _among(edges, anchor.view(np.int64))
            _, begin, size, inner, outer = _cells(text, first[keep], count[keep], at[keep], length)
            whole, split = _among(few, inner.view(np.int64)), _among(many, inner.view(np.int64))
            fresh = [k for k in np.flatnonzero(whole | split).tolist() if (key := (int(inner[k]), int(outer[k]))) not in seen and not seen.add(key)]
            if not fresh:
                continue
            k = np.array(fresh)[whole[fresh]]
            pieces = [text.data[x:y].tobytes() for x, y in zip(begin[k].tolist(), (begin[k] + size[k] - 1 + length).tolist(), strict=True)]
            found.append((inner[k], outer[k], None, None, pieces))
            k = np.array(fresh)[split[fresh]]
            cell = np.repeat(k, size[k])
            step = np.arange(len(cell)) - np.repeat(np.cumsum(size[k]) - size[k], size[k])
            start = begin[cell] + step
            found.append((inner[cell], outer[cell], step, text.hashes(start, start + length), None))
            size_found += sum(map(len, pieces)) + 32 * len(cell)
            if size_found >= FLUSH:
                yield from map(_open_batch, _joined(found))
                found, size_found = [], 0
        yield from map(_open_batch, _joined(found))


def _joined(found: list) -> list:
    """The parts of ``found`` put together: pieces and windows."""
    out = []
    for kind in (True, False):
        own = [x for x in found if (x[4] is not None) == kind and len(x[0])]
        if own:
            arrays = [None if kind and i in (2, 3) else np.concatenate([x[i] for x in own]) for i in range(4)]
            out.append((*arrays, [p for x in own for p in x[4]] if kind else None))
    return out


def _open_batch(part: tuple) -> pa.RecordBatch:
    inner, outer, step, window, pieces = part
    n = len(inner)
    columns = [
        _signed(inner), _signed(outer), pa.nulls(n, pa.int32()) if step is None else pa.array(step.astype(np.int32)),
        pa.nulls(n, pa.int64()) if window is None else _signed(window), pa.nulls(n, pa.binary()) if pieces is None else pa.array(pieces, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["inner", "outer", "step", "window", "piece"])


def _marked(block: pa.Table, length: int) -> pa.Table:
    """The windows (by cell and step) of a block of distinct cells that the block's index finds anywhere else in it.

    Neighbouring cells of a text share less than ``length`` bytes, so no window meets itself.
    """
    data, offsets = as_bytes(block.column("piece"))
    at = np.flatnonzero(RunIndex(data, offsets).matching_statistics() >= length)
    cell = np.searchsorted(offsets, at, "right") - 1
    rows = pa.array(cell)
    step = pa.array((at - offsets[cell]).astype(np.int32))
    return pa.table({"inner": block.column("inner").take(rows), "outer": block.column("outer").take(rows), "step": step})


def _cut(data: np.ndarray, spans: list, length: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, the rest) of a text whose windows from ``first`` on, ``count`` of them, go."""
    change = np.zeros(len(data) + 1, np.int64)
    first = np.array([s["first"] for s in spans], np.int64)
    end = first + np.array([s["count"] for s in spans], np.int64) - 1 + length
    np.add.at(change, first, 1)
    np.add.at(change, end, -1)
    gone = np.cumsum(change[:-1]) > 0
    begins = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), begins, data[~gone].tobytes()


def _removed(batches, length, with_text):
    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            own = data[offsets[i] : offsets[i + 1]]
            removed, n, rest = _cut(own, spans or [], length)
            out["n_bytes"].append(len(own))
            out["n_removed"].append(removed)
            out["n_spans"].append(n)
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            out["kept"].append(rest if with_text else None)
        kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
        names = [c for c in batch.schema.names if c not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]], [*names, *out])


def _hash() -> F.Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _filter(keys: DataFrame) -> np.ndarray | None:
    """The sorted keys (one long column) if there are FILTER_KEYS at most, else None: nothing is filtered by them."""
    if keys.count() > FILTER_KEYS:
        return None
    return np.sort(keys.toArrow().column(0).to_numpy())


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(th, spans): for each text (by MD5) with repeated windows, the runs (first, count) of windows that occur elsewhere."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(_hash().alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    met = texts.mapInArrow(lambda b: _anchors(b, length), _GROUPED)
    met = met.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("n > 1")
    anchors = saved(met.select("anchor", (F.col("lo") != F.col("hi")).alias("edge")), "anchors")
    known = context.broadcast((_filter(anchors.select("anchor")), _filter(anchors.where("edge").select("anchor"))))
    runs = texts.mapInArrow(lambda b: _runs(b, length, known), _RUNS)
    if known.value[0] is None or known.value[1] is None:
        runs = runs.join(anchors, "anchor").withColumn("cells", F.when(F.col("edge"), F.col("cells"))).drop("edge")
    runs = saved(runs, "runs")
    # Anchors of one content: every run is repeated.  Elsewhere a content is, if it occurs once more.
    edges = runs.where("cells IS NOT NULL")
    contents = edges.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("th", "first")).alias("run"), F.first("cells").alias("cells"))
    contents = saved(contents.withColumn("eid", F.monotonically_increasing_id()), "contents")
    again = edges.join(contents.where("n > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
    inside = runs.where("cells IS NULL").unionByName(again).select("th", "first", "count").distinct()
    # Different contents of an anchor: cells that are equal as a whole, then single windows of the others.
    cells = contents.select("eid", "run", (F.col("n") == 1).alias("once"), F.explode("cells").alias("c")).select("eid", "run", "once", "c.*")
    kinds = cells.groupBy("inner", "outer").agg(F.count("*").alias("n"), F.min("eid").alias("eid"), F.min("once").alias("once"))
    kinds = saved(kinds, "kinds")
    full = cells.where("once").join(kinds.where("n > 1").select("inner", "outer"), ["inner", "outer"], "left_semi")
    lone = (F.col("n") == 1) & F.col("once")
    opened = kinds.groupBy("inner").agg(F.count("*").alias("n"), F.max(lone).alias("any")).where("n > 1 AND any")
    opened = saved(opened.select("inner", "n"), "open")
    few, many = opened.where(F.col("n") <= BLOCK_CELLS // 2), opened.where(F.col("n") > BLOCK_CELLS // 2)
    wanted = context.broadcast((_filter(few.select("inner")), _filter(many.select("inner"))))
    met = saved(texts.mapInArrow(lambda b: _open_cells(b, length, known, wanted), _OPEN), "open_cells")
    pieces, windows = met.where("piece IS NOT NULL").select("inner", "outer", "piece"), met.where("piece IS NULL").drop("piece")
    if wanted.value[0] is None or wanted.value[1] is None:
        pieces, windows = pieces.join(few.select("inner"), "inner", "left_semi"), windows.join(many.select("inner"), "inner", "left_semi")
    # Small groups of cells: one run-length index a block.
    blocks = (few.agg(F.sum("n")).first()[0] or 0) // BLOCK_CELLS + 1
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("inner"), F.lit(blocks))).repartition("block")
    blocked = blocked.groupBy("block", "inner", "outer").agg(F.first("piece").alias("piece"))
    indexed = blocked.groupBy("block").applyInArrow(lambda t: _marked(t, length), _MARKS)
    # Large groups: equal windows by their hashes, in as many tasks as needed.
    twice = windows.groupBy("inner", "window").agg(F.min("outer").alias("lo"), F.max("outer").alias("hi")).where("lo != hi").select("inner", "window")
    single = indexed.union(windows.join(twice, ["inner", "window"], "left_semi").select("inner", "outer", "step").distinct())
    single = single.join(kinds.where(lone).select("inner", "outer", "eid"), ["inner", "outer"]).join(cells, ["eid", "inner", "outer"])
    place = lambda step, n: ("run.th", (F.col("run.first") + F.col("off") + step).cast("int").alias("first"), n.cast("int").alias("count"))
    outside = full.select(*place(F.lit(0), F.col("count"))).union(single.select(*place(F.col("step"), F.lit(1))))
    return inside.union(outside).groupBy("th").agg(F.collect_list(F.struct("first", "count")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Removes each byte that is covered by a string of ``length`` bytes which also starts anywhere else.

    Args: docs with ``doc_id`` and ``text``.  Returns per row: doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and kept (the remaining bytes if ``with_text``, else null).

    Strings are judged on the input; overlaps and repeats inside one document count, matches never cross documents.
    Equal windows are found by 64-bit hashes of their bytes together with that of their anchor.

    Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; of repeated rows each is the
    other's repeat, so long ones lose everything; an empty table gives no rows; other columns are ignored.
    """
    spans = saved(repeated_spans(docs, length), "spans")
    texts = docs.select("doc_id", _hash().alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    if at_most(spans, MARKED_TEXTS):
        # Texts that lose nothing stay where they are.
        told = texts.join(F.broadcast(spans.select("th", F.lit(True).alias("hit"))), "th", "left")
        free = told.where("hit IS NULL").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
        joined = told.where("hit").join(spans, "th").select("doc_id", "text", "spans").union(free)
    else:
        joined = texts.join(spans, "th", "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(lambda b: _removed(b, length, with_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op10_repeats": op10_repeats}
#: Tested against brute force over all windows.
ORACLES: dict[str, str] = {}
