"""Line deduplication by pairwise alignment.

Documents that share lines are paired: each with the earliest holder of each of its shared lines, however many texts
hold it, so the number of pairs never exceeds that of shared lines.  A pair is aligned with patience diff on line hashes (lines unique to both
sides anchor the alignment and equal neighbours extend it); aligned blocks are deleted from the later document.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, saved, table

#: Pairs by one line that go to one task with their earliest holder; of more, each part gets its own copy of the holder.
PART = 512
#: Lines with more holders than this meet their holders by a broadcast, if there are no more than so many of them.
FREQUENT, BROADCAST_LINES = 4096, 200_000
#: Shorter lines (code points, trimmed) pair nothing and are no block by themselves.
MIN_CHARS = 20


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.strip().encode(), digest_size=8).digest(), "big", signed=True)


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: increasing pairs (i, j) of equal lines a[i] == b[j]."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict[int, list[int]] = {}
        for side, lines, lo, hi in ((0, a, a0, a1), (1, b, b0, b1)):
            for i in range(lo, hi):
                own = once.setdefault(lines[i], [-1, -1])
                own[side] = i if own[side] == -1 else -2
        both = sorted((i, j) for i, j in once.values() if i >= 0 and j >= 0)
        # The longest increasing run of places in b, by patience sorting.
        piles: list[int] = []
        ends: list[int] = []
        before: list[int] = []
        for k, (_, j) in enumerate(both):
            at = bisect.bisect_left(piles, j)
            before.append(ends[at - 1] if at else -1)
            if at == len(piles):
                piles.append(j)
                ends.append(k)
            else:
                piles[at], ends[at] = j, k
        k = ends[-1] if ends else -1
        anchors = []
        while k >= 0:
            anchors.append(both[k])
            k = before[k]
        if not anchors:
            continue
        lo_a, lo_b = a0, b0
        for i, j in reversed(anchors):
            work.append((lo_a, i, lo_b, j))
            out.append((i, j))
            lo_a, lo_b = i + 1, j + 1
        work.append((lo_a, a1, lo_b, b1))
    return sorted(out)


def blocks(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first, end) of side b that side a has without a gap."""
    out: list[tuple[int, int]] = []
    last = None
    for i, j in pairs:
        if last is not None and (i, j) == (last[0] + 1, last[1] + 1):
            out[-1] = (out[-1][0], j + 1)
        else:
            out.append((j, j + 1))
        last = (i, j)
    return out


def _lined(batches):
    for batch in batches:
        ids, hashes, long = [], [], []
        for text in batch.column("text").to_pylist():
            lines = (text or "").split("\n")
            hashes.append([line_hash(x) for x in lines])
            long.append([len(x.strip()) >= MIN_CHARS for x in lines])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(hashes, pa.list_(pa.int64())), pa.array(long, pa.list_(pa.bool_()))], ["doc_id", "th", "lines", "long"])


def _aligned(batches):
    """Spans to delete; sorted so that the longer document of some pairs comes before the shorter ones of them."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    head: tuple = ()
    for batch in batches:
        later, spans = [], []
        for r in batch.to_pylist():
            if r["other"] is None:
                head = r["nid"], r["part"], r["lines"], r["long"]
                continue
            if head[:2] != (r["nid"], r["part"]):
                raise ValueError("a pair without its longer document")
            early, late, long = (head[2], r["lines"], r["long"]) if r["is_later"] else (r["lines"], head[2], head[3])
            own = [s for s in blocks(align(early, late)) if any(long[s[0] : s[1]])]
            if own:
                later.append(r["other"] if r["is_later"] else r["nid"])
                spans.append([{"first": x, "end": y} for x, y in own])
        if later:
            yield pa.RecordBatch.from_arrays([pa.array(later, pa.int64()), pa.array(spans, kind)], ["nid", "spans"])


def _cut(batches):
    for batch in batches:
        out = {"n_lines": [], "n_removed": [], "kept_text": []}
        for text, spans, whole in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), batch.column("whole").to_pylist(), strict=True):
            lines = (text or "").split("\n") if text else []
            gone = np.zeros(len(lines), bool)
            if whole:
                gone[:] = True
            for s in spans or ():
                gone[s["first"] : s["end"]] = True
            out["n_lines"].append(len(lines))
            out["n_removed"].append(int(gone.sum()))
            out["kept_text"].append("\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g))
        names = [c for c in batch.schema.names if c not in ("text", "spans", "whole")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array(out["n_lines"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_text"], pa.string())], [*names, *out]
        )


def removed_spans(docs: DataFrame) -> DataFrame:
    """(th, first_id, copies, spans) of the distinct texts: the first document with each, how many have it, the lines to delete."""
    hashed = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("th"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    lined = saved(hashed.mapInArrow(_lined, f"doc_id {kind}, th binary, lines array<bigint>, long array<boolean>"), "lined")
    # Equal texts are one node, held by the first of them; nodes are ordered by that document.
    nodes = lined.groupBy("th").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("lines").alias("lines"), F.first("long").alias("long"))
    nodes = saved(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    # The size goes along behind all that orders.
    order = F.struct(F.col("first_id").isNull().alias("no"), "first_id", "th", "nid", F.size("lines").alias("size"))
    held = nodes.select("nid", order.alias("o"), F.explode(F.array_distinct(F.filter(F.arrays_zip("lines", "long"), lambda x: x["long"]))).alias("x")).select("nid", "o", F.col("x.lines").alias("line"))
    counts = held.groupBy("line").agg(F.count("*").alias("n"), F.min("o").alias("first")).where("n > 1")
    counts = saved(counts.select("line", "n", F.col("first.nid").alias("early"), F.col("first.size").alias("early_size")), "lines")
    held, frequent = held.select("nid", F.col("o.size").alias("size"), "line"), counts.where(F.col("n") > FREQUENT)
    if at_most(frequent, BROADCAST_LINES):
        # The holders of a frequent line stay where they are, so that no task gets them all.
        known = F.broadcast(frequent)
        shared = held.join(known, "line").unionByName(held.join(known, "line", "left_anti").join(counts.where(F.col("n") <= FREQUENT), "line"))
    else:
        shared = held.join(counts, "line")
    shared = shared.select(F.col("nid").alias("later"), "early", F.ceil(F.col("n") / PART).alias("parts"), (F.col("size") <= F.col("early_size")).alias("is_later")).where("early != later")
    pairs = shared.groupBy("later", "early").agg(F.max("parts").alias("parts"), F.first("is_later").alias("is_later"))
    pairs = saved(pairs.withColumn("part", F.pmod(F.xxhash64("later"), "parts")), "pairs")
    # Of each pair the shorter document goes to the longer one, which is sent once to all of its pairs: what is moved grows
    # with the shorter documents.  The holder of a frequent line is in very many pairs: these are dealt over copies of it.
    lines = nodes.select("nid", "lines", "long")
    copies = pairs.select("early", "part").distinct()
    short_later = pairs.where("is_later").join(lines.withColumnRenamed("nid", "later"), "later").select(F.col("early").alias("nid"), "part", F.col("later").alias("other"), "is_later", "lines", "long")
    held_copies = copies.join(lines.withColumnRenamed("nid", "early"), "early")
    short_early = pairs.where("NOT is_later").join(held_copies, ["early", "part"]).select(F.col("later").alias("nid"), F.lit(0).cast("long").alias("part"), F.col("early").alias("other"), "is_later", "lines", "long")
    heads = pairs.select(F.when(F.col("is_later"), F.col("early")).otherwise(F.col("later")).alias("nid"), F.when(F.col("is_later"), F.col("part")).otherwise(F.lit(0)).cast("long").alias("part")).distinct().join(lines, "nid")
    heads = heads.select("nid", "part", F.lit(None).cast("long").alias("other"), F.lit(None).cast("boolean").alias("is_later"), "lines", "long")
    met = heads.unionByName(short_later).unionByName(short_early).repartition("nid", "part").sortWithinPartitions("nid", "part", F.col("other").asc_nulls_first())
    found = met.mapInArrow(_aligned, "nid bigint, spans array<struct<first:int,end:int>>")
    merged = found.groupBy("nid").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    return saved(nodes.select("nid", "th", "first_id", "copies").join(merged, "nid", "left").drop("nid"), "spans")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Deletes from every document the blocks of lines that it shares, aligned, with an earlier document.

    Args: docs with ``doc_id`` and ``text``.  Returns per row: doc_id, n_lines, n_removed and kept_text.  A block goes if
    it has a line of MIN_CHARS characters or more.  Lines are compared without white space at their ends.

    Defined cases: equal texts are one text, which the smallest doc_id keeps, and the others lose all lines; null
    doc_ids come last; of repeated rows with one doc_id all keep the text (they are the same document); null and empty
    texts have no lines; very long texts are aligned in full; an empty table gives no rows; other columns are ignored.
    """
    told = removed_spans(docs)
    texts = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("th"))
    often = told.where(F.col("copies") > FREQUENT)
    if at_most(often, BROADCAST_LINES):
        # The copies of a text that very many documents have stay where they are.
        known = F.broadcast(often)
        joined = texts.join(known, "th").unionByName(texts.join(known, "th", "left_anti").join(told.where(F.col("copies") <= FREQUENT), "th"))
    else:
        joined = texts.join(told, "th")
    whole = ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans", F.coalesce(whole, F.lit(False)).alias("whole")).mapInArrow(_cut, f"doc_id {kind}, n_lines long, n_removed long, kept_text string")


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("kept_text").cast("long").alias("n_kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op1_linededup": op1_linededup}
#: Patience diff is beyond SQL; tested against a brute-force version over all texts and lines.
ORACLES: dict[str, str] = {}
