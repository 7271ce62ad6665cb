"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the words of a window and ignore the others.  Benchmark and training windows that agree in the
picked words share a hash, whatever was substituted between them.  Around each such hit the item is laid along the
document on the hit's diagonal and the equal words are counted: the document is contaminated if some window of
``WINDOW`` words of the item (the whole item, if shorter) agrees in ``PERCENT`` per cent of them or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, saved, table
from .hashing import chunks, mix, word_hashes

#: 1: the word counts; 0: it is ignored.  Wherever PERCENT per cent of WINDOW words agree, one of the masks fits at some
#: place, and so does one of the short ones in items of MIN_ITEM to WINDOW - 1 words; tests enumerate all substitutions.
MASKS = ("1111011", "11001000111", "11010110001")
SHORT_MASKS = ("1111", "11011")
WINDOW, PERCENT = 15, 80
#: Items with fewer words prove nothing.
MIN_ITEM = 6
#: Benchmark words that are broadcast at a time; a larger benchmark is held against the documents in several passes.
SLICE_WORDS = 4_000_000
#: Diagonals, or words of diagonals, that are looked at together.
TOGETHER = 1 << 20
_FILTER_BITS = 22
_U = np.uint64


def _spaced(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the picked words of each window; windows run over the whole array."""
    n = len(words) - len(mask) + 1
    out = np.full(max(0, n), len(mask) * 1_000_003 + mask.count("1"), _U)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = out * _U(0xC2B2AE3D27D4EB4F) + words[i : i + max(0, n)]
    return mix(out)


def _runs(seeds: np.ndarray, places: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed, first place and length of the runs of one seed at consecutive places of a part (``places`` grow)."""
    new = np.ones(len(seeds), bool)
    new[1:] = (seeds[1:] != seeds[:-1]) | (places[1:] != places[:-1] + 1) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    return seeds[first], places[first], np.diff(np.append(first, len(seeds)))


class Seeds:
    """The spaced seeds of a slice of the benchmark: sorted runs of equal seeds, with the item and place of each."""

    def __init__(self, ids: list[list], texts: list[str | None]):
        words, starts, self.ids, n = [], [0], [], 0
        for item, text in zip(ids, texts, strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8)
            own = word_hashes(data, np.array([0, len(data)]))[0]
            if len(own) >= MIN_ITEM:
                words.append(own)
                self.ids.append(item)
                n += len(own)
                starts.append(n)
        self.words = np.concatenate(words) if words else np.zeros(0, _U)
        self.starts = np.array(starts)
        short = np.repeat(np.diff(self.starts) < WINDOW, np.diff(self.starts))
        found = []
        for mask in (*MASKS, *SHORT_MASKS):
            seeds = _spaced(self.words, mask)
            at = np.arange(len(seeds))
            item = np.searchsorted(self.starts, at, "right")
            inside = (item == np.searchsorted(self.starts, at + len(mask) - 1, "right")) & (short[: len(at)] == (mask in SHORT_MASKS))
            found.append(_runs(seeds[inside], at[inside], item[inside]))
        seeds, places, lengths = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.places, self.lengths = seeds[order], places[order], lengths[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.seeds >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def _diagonals(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The distinct (row, item, diagonal) of all hits; a diagonal is where in the row the item would begin."""
        out = np.zeros((0, 3), np.int64)
        for mask in (*MASKS, *SHORT_MASKS):
            found = _spaced(words, mask)
            at = np.flatnonzero(self.filter[(found >> _U(64 - _FILTER_BITS)).astype(np.int64)])
            row = np.searchsorted(rows, at, "right") - 1
            whole = at + len(mask) <= rows[row + 1]
            at, row = at[whole], row[whole]
            seeds, first, length = _runs(found[at], at, row)
            lo, hi = np.searchsorted(self.seeds, seeds, "left"), np.searchsorted(self.seeds, seeds, "right")
            cuts = np.flatnonzero(np.diff(np.cumsum((hi - lo) * length) // TOGETHER)) + 1
            for part in np.split(np.flatnonzero(hi > lo), np.searchsorted(np.flatnonzero(hi > lo), cuts)):
                n = hi[part] - lo[part]
                of = np.repeat(np.arange(len(n)), n)
                theirs = np.repeat(lo[part], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                # A run of the row against a run of the item: all diagonals between their ends.
                row = np.searchsorted(rows, first[part], "right") - 1
                item = np.searchsorted(self.starts, self.places[theirs], "right") - 1
                start = (first[part] - rows[row])[of] - (self.places[theirs] - self.starts[item]) - (self.lengths[theirs] - 1)
                many = length[part][of] + self.lengths[theirs] - 1
                whose = np.repeat(np.arange(len(of)), many)
                step = np.arange(len(whose)) - np.repeat(np.cumsum(many) - many, many)
                out = np.concatenate([out, np.stack([row[of][whose], item[whose], start[whose] + step], 1)])
                if len(out) > TOGETHER:
                    out = _distinct(out)
        return _distinct(out)

    def hits(self, words: np.ndarray, rows: np.ndarray) -> list[dict[int, int]]:
        """For each row: {item: equal words} of the items it contains; the best of the diagonals with a hit."""
        out: list[dict[int, int]] = [{} for _ in range(len(rows) - 1)]
        hits = self._diagonals(words, rows)
        hits = hits[np.argsort(hits[:, 1], kind="stable")]
        for own in np.split(hits, np.flatnonzero(np.diff(hits[:, 1])) + 1) if len(hits) else ():
            item = int(own[0, 1])
            text = self.words[self.starts[item] : self.starts[item + 1]]
            width, size = min(WINDOW, len(text)), max(1, TOGETHER // len(text))
            for k in range(0, len(own), size):
                row, diagonal = own[k : k + size, 0], own[k : k + size, 2]
                at = (rows[row] + diagonal)[:, None] + np.arange(len(text))
                inside = (at >= rows[row][:, None]) & (at < rows[row + 1][:, None])
                equal = inside & (words[np.where(inside, at, 0)] == text)
                sums = np.concatenate([np.zeros((len(equal), 1), np.int64), np.cumsum(equal, axis=1)], axis=1)
                best = (sums[:, width:] - sums[:, :-width]).max(axis=1)
                for j in np.flatnonzero(100 * best >= PERCENT * width).tolist():
                    r = int(row[j])
                    out[r][item] = max(out[r].get(item, 0), int(sums[j, -1]))
        return out


def _distinct(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort(rows.T)]
    return rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))] if len(rows) else rows


def _marked(batches, seeds, names):
    for batch in batches:
        items, words_n, equal = [], [], []
        for _, data, offsets in chunks(batch.column("text")):
            words, _, _, rows = word_hashes(data, offsets)
            words_n += np.diff(rows).tolist()
            for found in seeds.value.hits(words, rows):
                items.append(sorted((x for i in found for x in seeds.value.ids[i]), key=lambda x: (x is None, x)))
                equal.append(sum(n * len(seeds.value.ids[i]) for i, n in found.items()))
        more = {"__items": pa.array(items, pa.list_(pa.int64())), "n_words": pa.array(words_n, pa.int64()), "__equal": pa.array(equal, pa.int64())}
        yield pa.RecordBatch.from_arrays([more[c] if c in more else batch.column(c) for c in names], names)


def slices(benchmark: DataFrame) -> Iterator[tuple[bool, list]]:
    """(if it is the last, rows) of the slices of the benchmark, of bounded size: (ids, text) of each distinct text."""
    words = benchmark.agg(F.sum(F.regexp_count("text", F.lit(WORD))).alias("n")).first()["n"] or 0
    texts = benchmark.groupBy("text").agg(F.collect_list(F.struct(F.col("item_id").cast("long").alias("id"))).alias("ids"))
    n = -(-words // SLICE_WORDS) or 1
    for i in range(n):
        own = texts if n == 1 else texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i)
        yield i == n - 1, [([x["id"] for x in r["ids"]], r["text"]) for r in own.select("ids", "text").collect()]


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, keep_text: bool = True) -> DataFrame:
    """Adds item_ids (sorted), n_words and equal_words to documents: the benchmark items that they contain.

    Args: docs with ``text``, benchmark with ``item_id`` and ``text``.  Any other columns of docs pass through, but for
    those of the added names.  A pass over the documents for each slice of the benchmark, written before the next, so
    that one slice is in memory at a time; nothing is shuffled.

    Every window of WINDOW words of an item, or every item of MIN_ITEM words or more that is shorter, of which PERCENT
    per cent stand in the document at their places, is found, whatever the substitutions.

    Defined cases: null, empty and short texts contain nothing; items of fewer than MIN_ITEM words are ignored; null
    item_ids are listed as nulls, last; equal items are all listed; repeated rows are marked alike; an empty benchmark
    marks nothing; whole texts are read, however long.
    """
    added = ("item_ids", "n_words", "equal_words")
    out = docs.select(*[c for c in docs.columns if c not in added], F.array().cast("array<bigint>").alias("item_ids"), F.lit(0).cast("long").alias("equal_words"))
    context = docs.sparkSession.sparkContext
    for last, rows in slices(benchmark):
        seeds = context.broadcast(Seeds([r[0] for r in rows], [r[1] for r in rows]))
        drop = ("n_words", "text") if last and not keep_text else ("n_words",)
        fields = [(f.name, f.dataType.simpleString()) for f in out.schema if f.name not in drop]
        fields += [("__items", "array<bigint>"), ("n_words", "bigint"), ("__equal", "bigint")]
        out = out.mapInArrow(lambda b, s=seeds, n=[x for x, _ in fields]: _marked(b, s, n), ", ".join(f"`{x}` {t}" for x, t in fields))
        both = F.array_sort(F.concat("item_ids", "__items"))
        out = out.withColumns({"item_ids": both, "equal_words": F.col("equal_words") + F.col("__equal")}).drop("__items", "__equal")
        if not last:
            out = saved(out, "marked")
            seeds.destroy()
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item; columns as given.  Cases as in mark_contaminated."""
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*rest).alias("__row"), "text") if rest else docs
    clean = mark_contaminated(packed, benchmark).where(F.size("item_ids") == 0)
    return clean.select(*[(F.col(c) if c == "text" else F.col("__row")[c]).alias(c) for c in docs.columns])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mark_contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select("doc_id", "n_words", "item_ids", "equal_words", (F.size("item_ids") > 0).alias("contaminated"))


QUERIES = {"op6_decontamination": op6_decontamination}
#: Tested against brute force over all windows of items and places in documents.
ORACLES: dict[str, str] = {}
