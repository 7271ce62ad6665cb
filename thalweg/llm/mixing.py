"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources share ``SHARE`` times all words by weight, none beyond ``MAX_PASSES`` times its own.  The mix is a line of
blocks of equal numbers of words.  Each mix shard is a run of blocks, and highest quotients tell how many blocks of it
each source fills: integer quotas.  Within a source, documents follow one another in seeded order, which cuts the
source into blocks in that order; shards take a source's blocks from the front, and again from the front after the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, saved, table, with_prefix
from .quality import _has, _RARE_SPACES

SEED = 17
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_PASSES = 2
#: Blocks in the mix, and blocks in each source's target, at least (where a block of one word does not come first): they
#: set how close the words taken come to the targets, at any input size and however small a source is beside the others.
BLOCKS = 65_536
SOURCE_BLOCKS = 1_000
#: Mix shards that get quotas of their own.
MIX_SHARDS = 8
#: Tables of sources up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: str) -> str:
    """SQL for the number of words: from the number of spaces where words are one space apart, else by cutting."""
    spaced = f"replace(CASE WHEN {_has(text, _RARE_SPACES)} THEN translate({text}, '{''.join(_RARE_SPACES)}', '    ') ELSE {text} END, '\\n', ' ')"
    by_space = "octet_length(t) - octet_length(replace(t, ' ', '')) + 1"
    plain = "t != '' AND NOT startswith(t, ' ') AND NOT endswith(t, ' ') AND NOT contains(t, '  ')"
    return f"cast(transform(array({spaced}), t -> CASE WHEN {plain} THEN {by_space} ELSE size(filter(split(t, ' '), w -> w != '')) END)[0] as bigint)"


def _key() -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), F.col("doc_id").cast("string"), F.col("text")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if at_most(df, BROADCAST_SOURCES) else df


def targets(sources: DataFrame) -> DataFrame:
    """Adds weight, source_row and target to (source, source_size): shares by weight, stopped at MAX_PASSES times the size.

    The level at which uncapped sources get ``level * weight`` is found from running totals in order of size by weight,
    so that reshared excess never has to be passed round.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("row") % len(WEIGHTS) + 1).cast("int"))
    ranked = with_prefix(sources, [F.col("source").asc_nulls_last()], {}, "sources")
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumnRenamed("row", "source_row").withColumn("cap", F.col("source_size") * MAX_PASSES)
    filled = with_prefix(ranked, [(F.col("cap") / F.col("weight")).asc(), F.col("source_row").asc()], {"c": F.col("cap"), "w": F.col("weight")}, "levels")
    share = F.col("c_all") * F.lit(SHARE / MAX_PASSES)
    capped = F.col("c_before") + F.col("cap") / F.col("weight") * (F.col("w_all") - F.col("w_before")) <= share
    filled = filled.withColumn("capped", capped)
    level = filled.agg(
        F.max(share).alias("share"),
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)).alias("c"),
        F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0)).alias("w"),
    ).first()
    per_weight = (level["share"] - level["c"]) / level["w"] if level["w"] else 0.0
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.lit(float(per_weight)) * F.col("weight"))
    return saved(filled.select("source", "source_size", "source_row", "weight", target.alias("target")), "targets")


def blocks_of_mix(sources: DataFrame) -> int:
    """The number of blocks by which a block is SOURCE_BLOCKS-th of the smallest target, or a word; BLOCKS if that is more."""
    whole = sources.agg(F.sum("target").alias("t"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    block = max(1, int((whole["least"] or 0) // SOURCE_BLOCKS))
    return max(BLOCKS, int(-(-(whole["t"] or 0.0) // block)))


def quotas(sources: DataFrame, blocks: int = BLOCKS, shards: int = MIX_SHARDS) -> DataFrame:
    """Sainte-Lague: (source columns, block, shard, quota, upto), a row per source and mix shard.

    Seat k of a source has the quotient target / (2k - 1); a house of n seats goes to the n highest quotients (ties: by
    source).  A larger house keeps all seats of a smaller one, so a shard's quota is the difference of two houses.  The
    divisor method bounds each source's seats from both sides; only the few seats between the bounds are ranked.
    """
    whole = sources.agg(F.sum("target").alias("t"), F.count("*").alias("n")).first()
    total, n = float(whole["t"] or 0.0), int(whole["n"])
    block = max(1, -int(-total // blocks))
    seats = round(total / block)
    house = F.explode(F.array(*[F.struct(F.lit(h).alias("shard"), F.lit(seats * (h + 1) // shards).alias("house")) for h in range(shards)]))
    each = F.col("target") / F.lit(total or 1.0)
    low = F.greatest(F.lit(0), F.floor(each * (F.col("house") - n / 2) + 0.5) - 1)
    high = F.floor(each * (F.col("house") + n / 2) + 0.5) + 1
    bounds = sources.select("*", house.alias("__h")).select("*", "__h.shard", "__h.house").drop("__h").withColumns({"low": low, "high": high})
    open_seats = bounds.select("source_row", "shard", "target", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("k"))
    order = [F.col("shard").asc(), (F.col("target") / (2 * F.col("k") - 1)).desc(), F.col("source_row").asc(), F.col("k").asc()]
    ranked = with_prefix(open_seats, order, {}, "seats")
    houses = bounds.groupBy("shard").agg((F.max("house") - F.sum("low")).alias("left"))  # a row per mix shard
    first = ranked.groupBy("shard").agg(F.min("row").alias("first"))
    won = (
        ranked.join(F.broadcast(houses), "shard")
        .join(F.broadcast(first), "shard")
        .where((F.col("row") - F.col("first") < F.col("left")) & (F.col("target") > 0))
        .groupBy("source_row", "shard")
        .agg(F.count("*").alias("more"))
    )
    upto = bounds.join(won, ["source_row", "shard"], "left").withColumn("upto", F.col("low") + F.coalesce("more", F.lit(0)))
    smaller = upto.select("source_row", (F.col("shard") + 1).alias("shard"), F.col("upto").alias("before"))
    return upto.join(smaller, ["source_row", "shard"], "left").select(
        "source", "source_size", "source_row", "weight", "target", F.lit(block).cast("long").alias("block"), "shard",
        (F.col("upto") - F.coalesce("before", F.lit(0))).cast("long").alias("quota"), F.col("upto").cast("long").alias("upto"),
    )


def plan_mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the mix takes: (a row per document, a row per source).

    Documents: doc_id, source, key, size, source_size, target, mix_shards (the mix shards that take words of it), taken.  Each
    shard takes the blocks of its quota from where the one before has stopped.  Sources: source, passes (whole times that all
    its documents are taken) and end_key, end_id, end_words: documents before this one in seeded order are taken once
    more, and so are this one's first ``end_words`` words (nulls: no further pass).

    Defined cases: a null text has no words; a null source is a source of its own, the last; repeated rows are rows of
    their own; documents without words take nothing; an empty table gives none; other columns are ignored.  At most one
    document of a source is taken in part.
    """
    sized = docs.select("doc_id", "source", _key().alias("key"), F.expr(word_count("coalesce(text, '')")).alias("size"))
    order = [F.col("source").asc_nulls_last(), F.col("key").asc(), F.col("doc_id").asc_nulls_first()]
    line = saved(with_prefix(sized, order, {"w": F.col("size")}, "words").drop("row", "w_all"), "line")
    sources = targets(line.groupBy("source").agg(F.sum("size").alias("source_size")))
    starts = line.groupBy("source").agg(F.min("w_before").alias("start"))
    uptos = F.transform(F.array_sort(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"])  # a number a mix shard
    whole = quotas(sources, blocks_of_mix(sources)).groupBy("source_row").agg(
        *[F.first(c).alias(c) for c in ("source", "source_size", "target", "block")], F.sum("quota").alias("quota"), uptos.alias("uptos")
    )
    own_blocks = F.ceil(F.col("source_size") / F.col("block"))
    whole = (
        whole.withColumn("own", own_blocks)
        .withColumn("quota", F.least("quota", F.col("own") * MAX_PASSES))
        .withColumn("passes", F.when(F.col("own") > 0, F.expr("quota div own")).otherwise(0))
        .withColumn("more", F.when(F.col("own") > 0, F.col("quota") % F.col("own") * F.col("block")).otherwise(0))
        .alias("s")
        .join(starts.withColumnRenamed("source", "__source").alias("t"), F.col("s.source").eqNullSafe(F.col("__source")))
        .drop("__source")
    )
    whole = saved(whole.select("source", "source_size", "target", "passes", "more", "start", "own", "block", "uptos"), "quotas")
    named = _small(whole.withColumnRenamed("source", "__source"))
    placed = line.join(named, F.col("source").eqNullSafe(F.col("__source"))).withColumn("at", F.col("w_before") - F.col("start"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("more") - F.col("at")))
    # Words of a document that a shard takes: where its blocks meet the document in any pass over the source.
    met = "greatest(0L, least(p * own * block + at + size, u * block) - greatest(p * own * block + at, CASE WHEN h = 0 THEN 0L ELSE uptos[greatest(h - 1, 0)] * block END))"
    shares = F.expr(f"transform(uptos, (u, h) -> aggregate(sequence(0L, {MAX_PASSES - 1}L), 0L, (a, p) -> a + {met}))")
    placed = placed.withColumn("shares", shares)
    rows = placed.select(
        "doc_id", "source", "key", "size", "source_size", "target", "passes", part.alias("part"),
        F.expr("filter(transform(shares, (w, h) -> CASE WHEN w > 0 THEN h END), h -> h IS NOT NULL)").alias("mix_shards"),
        F.aggregate("shares", F.lit(0).cast("long"), lambda a, w: a + w).alias("taken"),
    )
    last = F.max(F.when(F.col("part") > 0, F.struct("key", "doc_id", F.col("part").alias("words"))))
    ends = rows.groupBy("source").agg(F.max("passes").cast("int").alias("passes"), last.alias("end"))
    return rows, ends.select("source", "passes", F.col("end.key").alias("end_key"), F.col("end.doc_id").alias("end_id"), F.col("end.words").alias("end_words"))


_PIECES = r"split(text, '(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])')"


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed documents: each as many times as taken, the last of a source cut after the words that are taken.

    Takes and returns the columns of ``docs`` (n_chars is brought up to date if there is one).  Texts stay where they
    are: the plan is made from sizes alone, and each row is held against its source's end.  Cases as in plan_mix.
    """
    _, ends = plan_mix(docs)
    ends = _small(saved(ends.select(*[F.col(c).alias(f"__{c}") for c in ends.columns]), "ends"))
    key, end = _key(), F.col("__end_key")
    same = (key == end) & F.col("doc_id").eqNullSafe(F.col("__end_id"))
    before = (key < end) | ((key == end) & ~same)
    cut = F.expr(f"array_join(slice({_PIECES}, 1, cast(__end_words as int) + CASE WHEN text rlike '^[\\\\x20\\\\x09-\\\\x0D]' THEN 1 ELSE 0 END), '')")
    more = F.when(before, F.array("text")).when(same, F.array(cut)).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat("text", F.col("__passes")), F.coalesce(more, F.array().cast("array<string>")))
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    taken = docs.where(has_words).join(ends, F.col("source").eqNullSafe(F.col("__source"))).select(*[c for c in docs.columns if c != "text"], F.explode(texts).alias("text"))
    new = {"n_chars": F.length("text").cast("long")}
    return taken.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = plan_mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.array_join("mix_shards", ",").alias("mix_shards"))


QUERIES = {"op9_mixing": op9_mixing}

_SQL = f"""
WITH d AS (SELECT doc_id, source, md5(concat_ws('|', '{SEED}', cast(doc_id AS VARCHAR), text)) AS k,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
line AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS pos FROM d),
s0 AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s0),
s2 AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS c0, coalesce(sum(weight) OVER w, 0) AS w0,
    sum(cap) OVER () AS c_all, sum(weight) OVER () AS w_all FROM s2
    WINDOW w AS (ORDER BY cast(cap AS DOUBLE) / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, c0 + cast(cap AS DOUBLE) / weight * (w_all - w0) <= c_all * 0.75e0 AS capped FROM s3),
lv AS (SELECT (max(c_all) * 0.75e0 - coalesce(sum(CASE WHEN capped THEN cap END), 0)) / nullif(cast(sum(CASE WHEN NOT capped THEN weight ELSE 0 END) AS DOUBLE), 0) AS lvl FROM s4),
s5 AS (SELECT source, source_size, r, CASE WHEN capped THEN cast(cap AS DOUBLE) ELSE lvl * weight END AS target FROM s4, lv),
b AS (SELECT cast(greatest(1, ceil(t / greatest({BLOCKS}, ceil(t / greatest(1, floor(coalesce(least, 0) / {SOURCE_BLOCKS})))))) AS BIGINT) AS block, t
    FROM (SELECT coalesce(sum(target), 0) AS t, min(CASE WHEN target > 0 THEN target END) AS least FROM s5)),
h AS (SELECT block, cast(round_even(t / block, 0) AS BIGINT) AS seats, t FROM b),
seat AS (SELECT r, k, target / (2 * k - 1) AS q FROM (SELECT r, target, unnest(generate_series(1, cast(floor(target / t * (seats + 64)) AS BIGINT) + 3)) AS k FROM s5, h WHERE target > 0)),
won AS (SELECT r, shard, count(*) FILTER (n <= seats * (shard + 1) // {MIX_SHARDS}) AS upto FROM (SELECT r, row_number() OVER (ORDER BY q DESC, r, k) AS n FROM seat), h, range({MIX_SHARDS}) g(shard) GROUP BY r, shard),
quota AS (SELECT r, list(upto ORDER BY shard) AS uptos FROM won GROUP BY r),
s6 AS (SELECT source, source_size, target, block, cast(ceil(cast(source_size AS DOUBLE) / block) AS BIGINT) AS own, coalesce(uptos, list_transform(range({MIX_SHARDS}), lambda g: 0)) AS uptos FROM s5 LEFT JOIN quota USING (r), b),
met AS (SELECT doc_id, size, source_size, target, list_transform(range({MIX_SHARDS}), lambda g: list_sum(list_transform(range({MAX_PASSES}), lambda p:
    greatest(0, least(p * own * block + pos + size, uptos[g + 1] * block) - greatest(p * own * block + pos, CASE WHEN g = 0 THEN 0 ELSE uptos[g] * block END))))) AS shares
  FROM line JOIN s6 ON line.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target, cast(list_sum(shares) AS BIGINT) AS taken, array_to_string(list_filter(range({MIX_SHARDS}), lambda g: shares[g + 1] > 0), ',') AS mix_shards FROM met
"""
ORACLES = {"op9_mixing": _SQL}
