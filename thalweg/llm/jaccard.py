"""Jaccard similarity join of word-shingle sets with token-combination prefixes.

Tokens are ordered by how common they are (rarest first).  A set that links to another misses at most ``slack`` of its
tokens there, so of any ``slack + 1`` tokens they share one.  Rare tokens are indexed alone.  Frequent ones are dealt
into classes and indexed as pairs within a class, which hardly any unrelated texts share; as one token a class may be
lost to this, the prefix is extended until ``rare + sum(class size - 1) > slack``.  Candidates from equal index
entries are held against a bound from parity bitmaps, then verified on the whole sets.

A large group of like texts crowds into the same entries.  Such an entry is split: its members are compared with the
one that has the fewest rare tokens, and indexed anew by the tokens in which they differ from it, of which two members
that link to each other, but not both to the pivot, share some (for sets x and y with differences dx and dy to any
third set, ``|x ^ y| = |dx ^ dy|``).  So a crowd costs a star of pairs for each split and no link is lost.

The common tokens come from a sketch of fixed size.  It only sets the order, never the result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import at_most, saved, table
from .graph import components, merged
from .hashing import mix, shingle_sets

SHINGLE = 3
PERCENT = 90
#: Cells of the sketch of common tokens (a byte each when broadcast).
SKETCH_BITS = 20
#: Tokens whose cell counts 2**FREQUENT or more are frequent.
FREQUENT = 6
#: Tokens of a frequent class that should be indexed as pairs together, about.
CLASS_SIZE = 8
#: Entries before an entry that are looked through for one that has paired the same nodes.
LOOK_BACK = 8
#: Members of an entry that are all paired with one another, at first and after a split; a larger entry is split by what
#: its members differ in.
CROWD, SPLIT_CROWD = 64, 512
#: Splits in a row; entries that are still crowded then are paired in full.
SPLITS = 3
#: Pairs of one node that are verified in a task with it; of more, each part gets its own copy of its set.
PART = 512
#: Words of 64 bits of the parity bitmap in joins.  Large sets have a wide one too, of half a bit a token or more.
BITMAP_WORDS = 8
#: Up to this many texts are picked by a broadcast of their keys before they are shuffled; more are by the join.
BROADCAST_TEXTS = 200_000
#: Hashes that a task gathers before it counts them.
GATHER = 1 << 20
_U = np.uint64


def _counted(batches, k):
    """Cells and counts of the tokens that this task has met twice or more in what it gathered."""
    held, n = [], 0

    def flush():
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        tokens, counts = tokens[counts > 1], counts[counts > 1]
        cells, at = np.unique((tokens >> _U(64 - SKETCH_BITS)).astype(np.int32), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.bincount(at, counts, len(cells)).astype(np.int64))], ["cell", "n"])

    for batch in batches:
        for tokens in shingle_sets(batch.column(0), k):
            held.append(tokens)
            n += len(tokens)
            if n >= GATHER:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def common_cells(texts: DataFrame, k: int) -> np.ndarray:
    """log2 of the count in each cell of the sketch: 2**SKETCH_BITS bytes, whatever the input."""
    cells = texts.mapInArrow(lambda b: _counted(b, k), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    out[cells["cell"].to_numpy()] = np.log2(cells["n"].to_numpy()).astype(np.uint8)
    return out


def _level(tokens, common):
    return common[(tokens >> _U(64 - SKETCH_BITS)).astype(np.int64)]


def _least(n, percent):
    return -(-n * percent // 100)


def _class_counts(n, percent):
    """The numbers of frequent classes under which a set of n tokens is indexed: one is shared with any partner."""
    low, high = _least(n, percent), n * 100 // percent
    levels = range(int(np.log(max(1, low)) / np.log(1.25) - 1e-9), int(np.log(max(1, high)) / np.log(1.25) + 1e-9) + 1)
    return sorted({max(1, int((100 - percent) / 100 * 1.25**level / CLASS_SIZE)) for level in levels})


def entries(tokens: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The index entries of a set of sorted tokens."""
    n = len(tokens)
    slack = n - _least(n, percent)
    if n * 100 // percent == n and slack == 0:
        return tokens[:0]  # only equal sets link to it
    level = _level(tokens, common)
    tokens = tokens[np.argsort(level, kind="stable")]
    rare = int((level < FREQUENT).sum())
    if rare > slack:
        return tokens[: slack + 1]
    out, frequent = [tokens[:rare]], tokens[rare:]
    for classes in _class_counts(n, percent):
        of = mix(frequent ^ _U(0x51ED270B)) % _U(classes)
        members: dict[int, list[int]] = {}
        covered, pairs = rare, []
        for token, c in zip(frequent.tolist(), of.tolist(), strict=True):
            own = members.setdefault(c, [])
            pairs += [(token, x) if token < x else (x, token) for x in own]
            covered += bool(own)
            own.append(token)
            if covered > slack:
                break
        if pairs:
            a, b = np.array(pairs, _U).T
            out.append(mix(a * _U(0x9E3779B97F4A7C15) + mix(b + _U(classes))))
    return np.concatenate(out)


def _parity(tokens: np.ndarray, words: int) -> np.ndarray:
    counts = np.bincount((tokens & _U(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _wide_words(n: int) -> int:
    return max(BITMAP_WORDS, 1 << max(0, n // 128 - 1).bit_length())


def _described(batches, k, percent, common):
    for batch in batches:
        rows = {"n": [], "own": [], "sid": [], "entries": [], "bits": [], "wide": []}
        for tokens in shingle_sets(batch.column("text"), k):
            rows["n"].append(len(tokens))
            rows["own"].append(1000 * int((_level(tokens, common.value) < FREQUENT).sum()) // max(1, len(tokens)))
            rows["sid"].append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
            rows["entries"].append(entries(tokens, common.value, percent).view(np.int64))
            rows["bits"].append(_parity(tokens, BITMAP_WORDS))
            words = _wide_words(len(tokens))
            rows["wide"].append(_parity(tokens, words) if words > BITMAP_WORDS else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("th"), pa.array(rows["n"], pa.int64()), pa.array(rows["own"], pa.int32()), pa.array(rows["sid"], pa.binary()),
                pa.array(rows["entries"], pa.list_(pa.int64())), pa.array(rows["bits"], pa.list_(pa.int64())),
                pa.array(rows["wide"], pa.list_(pa.int64())),
            ],
            ["doc_id", "th", "n", "own", "sid", "entries", "bits", "wide"],
        )


def _sets(batches, k):
    for batch in batches:
        sets = [x.view(np.int64) for x in shingle_sets(batch.column("text"), k)]
        yield pa.RecordBatch.from_arrays([batch.column("nid"), pa.array(sets, pa.list_(pa.int64()))], ["nid", "tokens"])


def _rows_of(column):
    flat, at = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _verified(batches, percent):
    for batch in batches:
        keep = []
        for x, y in zip(_rows_of(batch.column("ta")), _rows_of(batch.column("tb")), strict=True):
            same = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * same >= percent * (len(x) + len(y) - same))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def difference_entries(x: np.ndarray, pivot: np.ndarray, common: np.ndarray, percent: int) -> tuple[bool, int, np.ndarray]:
    """If x links to the pivot, the size of its difference, and the tokens of it by which x is indexed against others.

    x and y with differences dx and dy link if dx and dy share (|dx| + |dy| - d) / 2 tokens or more, d being a bound of
    the symmetric difference of sets that link.  Where that is no more than 0, both link to the pivot.  Differences are
    ordered alike in all sets (what the pivot lacks first, rarest first), so the beginnings of two that link share a token.
    Where x links to the pivot, only those that do not, whose differences are over ``bound``, are looked for.
    """
    x, pivot = x.view(_U), pivot.view(_U)
    differ = np.setxor1d(x, pivot, assume_unique=True)
    n, m, size = len(x), len(pivot), len(differ)
    linked = size * (100 + percent) <= (n + m) * (100 - percent)
    most, bound = n * (100 - percent) // percent, (n * percent // 100 + m) * (100 - percent) // (100 + percent)
    at = np.minimum(np.searchsorted(pivot, differ), m - 1)
    level = np.where(pivot[at] == differ, 255, _level(differ, common))
    least = bound + 1 if linked else max(1, size - most)  # of the differences of others
    share = max(1, -(-(size + least - most) // 2))
    return linked, size, differ[np.lexsort((differ, level))][: max(0, size - share + 1)]


_SPLIT = "a long, b long, linked boolean, size int, entries array<bigint>"


def _split(batches, percent, common):
    """For pairs (pivot a, member b): if they link, the size of b's difference and its entries."""
    for batch in batches:
        told, sizes, rows = [], [], []
        for a, p, x in zip(batch.column("a").to_pylist(), _rows_of(batch.column("ta")), _rows_of(batch.column("tb")), strict=True):
            linked, size, tokens = difference_entries(x, p, common.value, percent)
            told.append(linked)
            sizes.append(size)
            rows.append(mix(tokens ^ mix(np.array([a], np.int64).view(_U) * _U(0x9E3779B97F4A7C15))).view(np.int64))
        columns = [batch.column("a"), batch.column("b"), pa.array(told, pa.bool_()), pa.array(sizes, pa.int32()), pa.array(rows, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "linked", "size", "entries"])


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _bits_fit(a: str, b: str, percent: int) -> Column:
    """False only if the parity bitmaps prove that the sets differ in too many tokens."""
    differ = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(BITMAP_WORDS)), F.lit(0))
    return differ * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def _wide_apart(batches, percent):
    """Drops pairs of large sets whose wide bitmaps prove that they differ in too many tokens."""
    for batch in batches:
        keep = []
        for x, y, n in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), batch.column("n").to_pylist(), strict=True):
            x, y = np.array(x, np.int64).view(_U), np.array(y, np.int64).view(_U)  # bitwise_count takes signed numbers by their absolute value
            if len(x) < len(y):
                x, y = y, x
            x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)  # parity of equal remainders
            keep.append(int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= n * (100 - percent))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _near(pairs: DataFrame, uniq: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs less those that wide bitmaps tell apart."""
    side = lambda s: uniq.select(F.col("nid").alias(s), F.col("wide").alias(f"w{s}"), F.col("n").alias(f"n{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("n", F.col("na") + F.col("nb"))
    wide = F.col("wa").isNotNull() & F.col("wb").isNotNull()
    told = both.where(wide).select("a", "b", "n", "wa", "wb").mapInArrow(lambda x: _wide_apart(x, percent), "a long, b long")
    return saved(both.where(~wide).select("a", "b").union(told), name)


def _with_sets(nids: DataFrame, uniq: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(nid, tokens) of the given nodes, from one text of each; texts are moved once, a copy of each per task."""
    wanted = saved(uniq.join(nids, "nid").select("th", "nid"), "wanted")
    texts = docs.select("th", "text")
    if wanted.count() <= BROADCAST_TEXTS:
        texts = texts.join(F.broadcast(wanted.select("th")), "th", "left_semi")
    texts = texts.groupBy("th").agg(F.first("text").alias("text"))
    return saved(texts.join(wanted, "th").select("nid", "text").mapInArrow(lambda b: _sets(b, k), "nid long, tokens array<long>"), "sets")


def _with_both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, ta, tb) of pairs (a, b).  The set of an ``a`` in many pairs is copied to as many tasks as needed."""
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("parts")).where("parts > 1")
    hot = saved(hot, "hot")
    hot = F.broadcast(hot) if at_most(hot, BROADCAST_TEXTS) else hot
    own = sets.select(F.col("nid").alias("a"), F.col("tokens").alias("ta")).join(hot, "a", "left")
    own = own.select("a", "ta", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    return dealt.join(own, ["a", "part"]).join(sets.select(F.col("nid").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return _with_both(pairs, sets).mapInArrow(lambda x: _verified(x, percent), "a long, b long")


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label.withColumnRenamed("v", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))


def _mixed(entries: DataFrame, label: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The entries in which members of different components have yet to meet: (those of ``most`` members, larger ones)."""
    entries = _labelled(entries, label)
    tall = entries.groupBy("entry").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("linked").alias("whole")).where("lo != hi AND NOT whole")
    left = saved(entries.join(tall.select("entry", "c"), "entry"), "mixed")
    return left.where(F.col("c") <= most), left.where(F.col("c") > most)


def _stars(crowded: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(a, b): the members b of crowds with a pivot a of about their size, the one with the fewest rare tokens.

    Entries that overlap are one crowd, as far as the smallest node is passed on between them in two rounds: a large
    group of like texts, which is spread over very many entries, has one pivot or a few.  Sets that link differ by one
    level of size at most, so each is a member with its own level and with the next.
    """
    rows = crowded.select("entry", "nid", "label", F.col("nid").alias("crowd"))
    for _ in range(2):
        rows = rows.drop("crowd").join(rows.groupBy("entry").agg(F.min("crowd").alias("crowd")), "entry")
        rows = rows.drop("crowd").join(rows.groupBy("nid").agg(F.min("crowd").alias("crowd")), "nid")
    crowds = rows.groupBy("entry").agg(F.min("crowd").alias("crowd"))
    rows = rows.drop("crowd").join(crowds, "entry").select("crowd", "nid", "label").distinct()
    level = F.floor(F.log("n") / F.lit(math.log(100 / percent)) + 1e-9).cast("int")
    rows = saved(rows.join(sizes.select("nid", "n", "own"), "nid").withColumn("level", F.explode(F.array(level, level + 1))), "crowds")
    pivots = rows.groupBy("crowd", "level").agg(F.min(F.struct("own", "nid")).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    return rows.join(pivots.select("crowd", "level", F.col("p.nid").alias("a")), ["crowd", "level"]).where("a != nid").select("a", F.col("nid").alias("b")).distinct()


def _close_pairs(left: DataFrame, sizes: DataFrame, percent: int, first: bool) -> DataFrame:
    """(a, b): all pairs of different components within entries that sizes and bitmaps do not tell apart."""
    if first:  # nodes that share an entry before this one have met there already: only their first is sure to pair them
        recent = W.partitionBy("nid").orderBy("entry").rowsBetween(-LOOK_BACK, -1)
        left = left.withColumn("before", F.collect_list("entry").over(recent))
    else:
        left = left.withColumn("before", F.array().cast("array<bigint>"))
    left = saved(left.join(sizes.select("nid", "n", "bits"), "nid").select("entry", "place", "size", "before", "nid", "label", "n", "bits"), "small")
    x, y = left.alias("x"), left.alias("y")
    # What two differences have to share, so that each has its token by then; entries of whole sets have no size.
    share = F.greatest(F.lit(1), F.ceil((F.col("x.size") + F.col("y.size") - F.floor((F.col("x.n") + F.col("y.n")) * (100 - percent) / (100 + percent))) / 2))
    both = (
        (F.col("x.entry") == F.col("y.entry")) & (F.col("x.nid") < F.col("y.nid")) & (F.col("x.label") != F.col("y.label"))
        & ~F.arrays_overlap("x.before", "y.before") & F.coalesce((F.col("x.place") <= F.col("x.size") - share) & (F.col("y.place") <= F.col("y.size") - share), F.lit(True))
        & _sizes_fit(F.col("x.n"), F.col("y.n"), percent) & _bits_fit("x", "y", percent)
    )
    return x.join(y, both).select(F.col("x.nid").alias("a"), F.col("y.nid").alias("b")).distinct()


def similar_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Groups documents by links of Jaccard similarity ``percent`` / 100 or more between their k-word shingle sets.

    Args: docs with ``doc_id`` and ``text``.  Returns a row per input row: doc_id, th (MD5 of the text), n_shingles,
    group (an id, null without words) and component_id (the smallest doc_id of the group).

    Equal sets are one node from the start, so copies are never paired.  First every index entry pairs its members with
    the one that has the fewest rare tokens; what links is a component by then.  Only members of different components
    are paired with one another after that, in entries of up to CROWD members; larger ones are split before.

    Defined cases: a null, empty or blank text has an empty set and its own doc_id as component_id; fewer than k words
    are one shingle; null doc_ids are never the smallest unless the group has no other; repeated rows are rows of one
    node; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("th"))
    common = spark.sparkContext.broadcast(common_cells(docs.select("text"), k))
    nodes = saved(
        docs.mapInArrow(lambda b: _described(b, k, percent, common), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th binary, n long, own int, sid binary, entries array<long>, bits array<long>, wide array<long>"),
        "nodes",
    )
    uniq = nodes.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("th", "n", "own", "entries", "bits", "wide")])
    uniq = saved(uniq.withColumn("nid", F.monotonically_increasing_id()), "uniq")
    posted = uniq.select(F.explode("entries").alias("entry"), "nid", "own")
    shared = posted.groupBy("entry").agg(F.count("*").alias("c"), F.min(F.struct("own", "nid")).alias("p")).where("c > 1").select("entry", F.col("p.nid").alias("pivot"))
    live = saved(posted.join(shared, "entry").select("entry", "nid", "pivot"), "entries")

    sizes = uniq.select("nid", "n", "own", "bits")
    star = live.where("nid != pivot").select(F.col("pivot").alias("a"), F.col("nid").alias("b")).distinct()
    star = star.join(sizes.select(F.col("nid").alias("a"), F.struct("n", "bits").alias("x")), "a").join(sizes.select(F.col("nid").alias("b"), F.struct("n", "bits").alias("y")), "b")
    star = star.where(_sizes_fit(F.col("x.n"), F.col("y.n"), percent) & _bits_fit("x", "y", percent)).select("a", "b")
    star = _near(star, uniq, percent, "star")
    ends = lambda p: p.select(F.col("a").alias("nid")).union(p.select("b")).distinct()
    sets = _with_sets(ends(star), uniq, docs, k)
    label = components(saved(_links(star, sets, percent), "links"))

    made, entries = 0, live.select("entry", "nid", F.lit(False).alias("linked"), F.lit(0).alias("place"), F.lit(None).cast("int").alias("size"))
    while entries is not None:
        small, crowded = _mixed(entries, label, SPLIT_CROWD if made else CROWD)
        made, entries = made + 1, None
        if not crowded.isEmpty():
            if made > SPLITS:
                small = small.union(crowded)
            else:
                pairs = saved(_stars(crowded, sizes, percent), "pivots")
                sets = sets.union(_with_sets(ends(pairs).join(sets.select("nid"), "nid", "left_anti"), uniq, docs, k))
                split = saved(_with_both(pairs, sets).mapInArrow(lambda x: _split(x, percent, common), _SPLIT), "split")
                label = merged(label, split.where("linked").select("a", "b"))
                entries = split.select(F.posexplode("entries").alias("place", "entry"), F.col("b").alias("nid"), "linked", "size").select("entry", "nid", "linked", "place", "size")
                small = _labelled(small.drop("label"), label)
        pairs = _close_pairs(small, sizes, percent, made == 1).join(star, ["a", "b"], "left_anti")
        pairs = _near(pairs, uniq, percent, "pairs")
        if not pairs.isEmpty():
            sets = sets.union(_with_sets(ends(pairs).join(sets.select("nid"), "nid", "left_anti"), uniq, docs, k))
            label = merged(label, saved(_links(pairs, sets, percent), "links"))
    grouped = saved(_labelled(uniq.select("sid", "nid", "first_id"), label).select("sid", "first_id", F.col("label").alias("group")), "groups")
    smallest = grouped.groupBy("group").agg(F.min("first_id").alias("component_id"))
    grouped = grouped.join(smallest, "group").select("sid", "group", "component_id")
    out = nodes.select("doc_id", "th", F.col("n").alias("n_shingles"), "sid").join(grouped, "sid", "left")
    own = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "th", "n_shingles", "group", own.alias("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents less all but one of each group: the row with the smallest doc_id (then text hash) stays.

    Columns as given.

    Defined cases: documents without words are in no group and all stay, repeated or not; a row with a null doc_id stays
    only if its group has no other; of repeated rows one stays; an empty table gives no rows; other columns pass through,
    whatever their names.
    """
    groups = saved(similar_groups(docs, k, percent), "similar")
    keep = groups.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("k"))
    keep = keep.select(F.col("k.doc_id").alias("__id"), F.col("k.th").alias("__kth"))
    hashed = docs.withColumn("__th", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = hashed.where(words).join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__kth")), "left_semi").dropDuplicates(["doc_id", "__th"])
    return kept.drop("__th").unionByName(docs.where(~words))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op3_jaccard": op3_jaccard}
#: Connected components over hashed shingles of all pairs are beyond a plain SQL query; tested against brute force.
ORACLES: dict[str, str] = {}
