"""Repair of the structure of conversations by a cheapest edit, found by bidirectional Dijkstra over the edit lattice.

A node of the lattice is how many rows are done and what the repaired roles so far allow next.  A forward heap starts at
the first row and a reverse heap behind the last; when they have met, all crossings of equal cost are finished, and the
least concatenated audit is read off what both sides settled.

Texts stay out of the search: a row is one byte in it.  Conversations of more than SEGMENT rows are cut into segments,
whose costs between boundary states are composed first; then every segment is searched by itself, in any task.  Only
the digest of a repaired conversation, which SHA-256 takes in order, has one task stream all its rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

#: Rows that are searched at once.
SEGMENT = 4096
#: States of the repaired roles: nothing yet, after a system row, after a user row, after an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted or reroled row becomes in each state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
RENAME, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: A row in a byte: the class of its role (0 s, 1 u, 2 a, 3 other), 4 if it has to go, 8 if it is cut off.
GONE, CUT = 4, 8
_SPACES = " \t\n\x0b\x0c\r"
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_END = object()


def _letters(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, next state, cost) of what can be done with a row, least letter first."""
    out = [("D", state, DELETE)]
    if not code & GONE:
        more = CUT_OFF if code & CUT else 0
        kind = code & 3
        if (kind == 0 and state == EMPTY) or (kind == 1 and NEXT[state] == USER) or (kind == 2 and NEXT[state] == ASSISTANT):
            out.append(("K", kind + 1, more))
        out.append(("R", NEXT[state], RENAME + more))
    return out


_AHEAD = [[_letters(code, q) for q in range(4)] for code in range(16)]
_BACK = [[[(p, cost) for p in range(4) for _, q, cost in _AHEAD[code][p] if q == to] for to in range(4)] for code in range(16)]
_INSERTED = [[p for p in range(4) if NEXT[p] == q] for q in range(4)]


def search(codes: bytes, entry: int, exits: list[float], last: bool) -> tuple[str, int]:
    """(audit, exit state) of the cheapest way through the rows ``codes`` from state ``entry``, the least audit of equal ones.

    ``exits`` are the costs to go from each state behind the last row; rows are inserted there only if it is the ``last``
    segment.  No audit of a way to a node begins another of the same cost, so that least letters first are least audits.
    """
    n = len(codes)

    def ahead(node):
        i, q = node >> 2, node & 3
        if i < n:
            yield from ((letter, (i + 1 << 2) + to, cost) for letter, to, cost in _AHEAD[codes[i]][q])
        if i < n or last:
            yield "I", (i << 2) + NEXT[q], INSERT

    def back(node):
        i, q = node >> 2, node & 3
        if i:
            yield from (((i - 1 << 2) + p, cost) for p, cost in _BACK[codes[i - 1]][q])
        if i < n or last:
            yield from (((i << 2) + p, INSERT) for p in _INSERTED[q])

    end = {(n << 2) + q: c for q, c in enumerate(exits) if c < math.inf}
    f, r, settled, done = {entry: 0}, dict(end), {}, {}
    forward, reverse = [(0, entry)], sorted((c, -v) for v, c in end.items())
    least = end.get(entry, math.inf)
    # Edges of no cost lead to later rows, so (cost, row) settles a node after all that lead to it at that cost.
    while (forward or reverse) and (forward[0][0] if forward else 0) + (reverse[0][0] if reverse else 0) <= least:
        if forward and (not reverse or len(settled) <= len(done)):
            c, u = heapq.heappop(forward)
            if u in settled:
                continue
            settled[u] = c
            least = min(least, c + end.get(u, math.inf))
            for _, v, w in ahead(u):
                least = min(least, c + w + r.get(v, math.inf))
                if c + w < f.get(v, math.inf):
                    f[v] = c + w
                    heapq.heappush(forward, (c + w, v))
        else:
            c, v = heapq.heappop(reverse)
            v = -v
            if v in done:
                continue
            done[v] = c
            for u, w in back(v):
                least = min(least, c + w + f.get(u, math.inf))
                if c + w < r.get(u, math.inf):
                    r[u] = c + w
                    heapq.heappush(reverse, (c + w, -u))
    # All crossings of the least cost: an edge from a node settled forwards to one settled backwards, or an exit.
    on = set()
    for u in reversed(settled):
        c = settled[u]
        if c + end.get(u, math.inf) == least or any((v in done and c + w + done[v] == least) or (v in on and c + w == settled[v]) for _, v, w in ahead(u)):
            on.add(u)
    u, before, after, audit = entry, True, False, []
    while not ((before and settled[u] + end.get(u, math.inf) == least) or (after and end.get(u) == done[u])):
        ways = []
        for letter, v, w in ahead(u):
            stays = before and v in on and settled[u] + w == settled[v]
            crosses = v in done and ((before and settled[u] + w + done[v] == least) or (after and done[u] == w + done[v]))
            if stays or crosses:
                ways.append((letter, v, stays, crosses))
        letter, u, before, after = min(ways)
        audit.append(letter)
    return "".join(audit), u & 3


def _inserts(costs: list[float]) -> list[float]:
    out = list(costs)
    for _ in range(2):
        for q in range(4):
            out[NEXT[q]] = min(out[NEXT[q]], out[q] + INSERT)
    return out


def transfer(codes: bytes) -> list[float]:
    """The least costs from each state before the rows to each state behind the last, rows inserted before and between."""
    out: list[float] = []
    for q in range(4):
        costs = [0 if p == q else math.inf for p in range(4)]
        for code in codes:
            costs, now = [math.inf] * 4, _inserts(costs)
            for p in range(4):
                for _, to, w in _AHEAD[code][p]:
                    costs[to] = min(costs[to], now[p] + w)
        out += costs
    return out


def _whole(costs: list[float]) -> list[int]:
    return [-1 if c == math.inf else int(c) for c in costs]


def _columns(batch, *names):
    return zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _batches(rows, schema: pa.Schema, most: int = 4096):
    """Record batches of row tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _segments(batches):
    """(conv_id, at, part, codes, costs) of runs of rows, sorted by place: of one conversation, SEGMENT at most."""
    current, start, part, held = _END, 0, 0, bytearray()
    for batch in batches:
        for conv, at, code, copies in _columns(batch, "conv_id", "at", "code", "copies"):
            fresh = True
            while copies:
                if held and (conv != current or len(held) >= SEGMENT):
                    yield current, start, part, bytes(held), _whole(transfer(held))
                    held = bytearray()
                if not held:
                    current, start, part = conv, at, 0 if fresh else part + 1
                take = 1 if fresh else min(copies, SEGMENT - len(held))
                # What repeats the row has to go, whatever it is.
                held += bytes([code if fresh else code & 3 | GONE]) * take
                fresh, copies = False, copies - take
    if held:
        yield current, start, part, bytes(held), _whole(transfer(held))


def _illegal(codes: bytes) -> int:
    return sum((a & 3, b & 3) not in _LEGAL for a, b in zip(codes, codes[1:]))


def _composed(segments: list):
    """Adds to a conversation's segments the states they may be entered in, the costs behind them, the cost and the faults."""
    inf = math.inf
    costs = [[[inf if c < 0 else c for c in s[4][4 * q : 4 * q + 4]] for q in range(4)] for s in segments]
    # Costs to go behind each segment; behind the last, rows may still be inserted.
    go = [[0, inf, inf, 0]]
    end = list(go[0])
    for _ in range(2):
        end = [min(end[q], INSERT + end[NEXT[q]]) for q in range(4)]
    go = [end]
    for m in reversed(costs):
        go.append([min(m[q][p] + go[-1][p] for p in range(4)) for q in range(4)])
    go.reverse()
    reach, total = [0, inf, inf, inf], int(go[0][EMPTY])
    illegal = sum(_illegal(s[3]) for s in segments) + sum((a[3][-1] & 3, b[3][0] & 3) not in _LEGAL for a, b in zip(segments, segments[1:]))
    for k, (s, m) in enumerate(zip(segments, costs, strict=True)):
        last = k == len(segments) - 1
        entries = [q for q in range(4) if reach[q] + go[k][q] == total]
        yield (*s[:4], entries, [0, -1, -1, 0] if last else _whole(go[k + 1]), last, total, illegal)
        reach = [min(reach[q] + m[q][p] for q in range(4)) for p in range(4)]


def _entered(batches):
    """Segments with what their conversation says of them; sorted by conversation and place."""
    current, held = _END, []
    for batch in batches:
        for row in _columns(batch, "conv_id", "at", "part", "codes", "costs"):
            if row[0] != current:
                yield from _composed(held) if held else ()
                current, held = row[0], []
            held.append(row)
    yield from _composed(held) if held else ()


def _searched(batches):
    for batch in batches:
        for conv, at, part, codes, entries, exits, last, cost, illegal in _columns(batch, "conv_id", "at", "part", "codes", "entries", "exits", "last", "cost", "illegal"):
            ways = [search(codes, q, [math.inf if c < 0 else c for c in exits], last) for q in entries]
            yield conv, at, part, cost, illegal, [{"entry": q, "exit": to, "audit": audit} for q, (audit, to) in zip(entries, ways, strict=True)]


class _Conversation:
    """A conversation whose segments and rows come by in order."""

    def __init__(self, conv):
        self.conv, self.state, self.at, self.letters, self.audit = conv, EMPTY, EMPTY, [], []
        self.cost = self.illegal = 0

    def segment(self, cost, illegal, ways):
        way = next(w for w in ways if w["entry"] == self.state)
        self.state = way["exit"]
        self.cost, self.illegal = cost, illegal
        self.audit.append(way["audit"])
        self.letters = [*reversed(way["audit"]), *self.letters]

    def inserted(self):
        while self.letters and self.letters[-1] == "I":
            self.letters.pop()
            self.at = NEXT[self.at]
            yield ROLE[self.at], "", "I"

    def row(self, role, text, copies):
        """(role, text, edit) of the repaired rows for a row and what is inserted before it."""
        for k in range(copies):
            yield from self.inserted()
            letter = self.letters.pop()
            if letter == "R":
                self.at = NEXT[self.at]
                yield ROLE[self.at], text, "R"
            elif letter == "K":
                self.at = "sua".index(role[0]) + 1
                yield role, text, "K"


def _streamed(batches):
    """Conversations one after the other: (conversation, an iterator of its repaired rows); sorted by place."""
    now = None
    for batch in batches:
        for conv, cost, illegal, ways, role, text, copies in _columns(batch, "conv_id", "cost", "illegal", "ways", "role", "text", "copies"):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now, now.inserted(), True
                now = _Conversation(conv)
            if ways is not None:
                now.segment(cost, illegal, ways)
            else:
                yield now, now.row(role, text, copies), False
    if now is not None:
        yield now, now.inserted(), True


def _digests(batches):
    digest, first = hashlib.sha256(), True
    for now, rows, over in _streamed(batches):
        for role, text, _ in rows:
            digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False
        if over:
            yield now.conv, now.cost, now.illegal, "".join(now.audit), digest.hexdigest()
            digest, first = hashlib.sha256(), True


def _rows(batches):
    place = 0
    for now, rows, over in _streamed(batches):
        for role, text, edit in rows:
            yield now.conv, place, role, text, edit
            place += 1
        if over:
            place = 0


_INTS, _KIND = pa.list_(pa.int64()), {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}
_WAYS = "array<struct<entry:bigint,exit:bigint,audit:string>>"
_WAY = pa.list_(pa.struct([("entry", pa.int64()), ("exit", pa.int64()), ("audit", pa.string())]))
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": _INTS, _WAYS: _WAY}


def _mapped(df: DataFrame, rows, kind: str, columns: dict[str, str]) -> DataFrame:
    """``df`` through a function from batches to row tuples; the first column is the conversation's id."""
    schema = pa.schema([("conv_id", _KIND[kind]), *[(c, _TYPES[t]) for c, t in columns.items()]])
    return df.mapInArrow(lambda b: _batches(rows(b), schema), f"conv_id {kind}, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


def _last(text: Column) -> Column:
    """The last character that is not white space; empty if there is none."""
    return F.right(F.rtrim(text, F.lit(_SPACES)), F.lit(1))


def _marked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in order (equal ones folded into ``copies``), and without texts but with their faults; both saved."""
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    folded = plain.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    ordered = folded.repartitionByRange(*key, F.left("text", F.lit(32))).sortWithinPartitions(*key, "text")
    ordered = saved(ordered.withColumn("at", F.monotonically_increasing_id()), "turns")
    told = ordered.select("conv_id", "turn", "at", "copies", F.left("role", F.lit(1)).alias("initial"), _last(F.col("text")).alias("end"), F.unhex(F.md5(F.concat_ws("\0", "role", "text"))).alias("same"))
    firsts = told.groupBy("conv_id", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    blank = F.col("end") == ""
    again = ~blank & F.col("first").isNull()
    cut = ~blank & ~again & ~F.col("end").isin(".", "!", "?")
    kind = F.coalesce(F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2), F.lit(3))
    marked = told.join(firsts, "at", "left").select(
        "conv_id", "turn", "at", "copies", (kind + F.when(blank | again, GONE).otherwise(0) + F.when(cut, CUT).otherwise(0)).alias("code"),
        F.when(blank, F.col("copies")).otherwise(0).alias("blank"), F.when(again, F.col("copies")).when(blank, 0).otherwise(F.col("copies") - 1).alias("duplicate"), cut.cast("long").alias("truncated"),
    )
    return ordered, saved(marked, "marked")


def _solved(ordered: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows and solved segments of each conversation in one partition, in order, a segment before its rows."""
    kind = ordered.schema["conv_id"].dataType.simpleString()
    lines = marked.select("conv_id", "at", "code", "copies").repartitionByRange("at").sortWithinPartitions("at")
    segments = _mapped(lines, _segments, kind, {"at": "long", "part": "long", "codes": "binary", "costs": "array<bigint>"})
    entered = _mapped(
        segments.repartition("conv_id").sortWithinPartitions("conv_id", "at", "part"), _entered, kind,
        {"at": "long", "part": "long", "codes": "binary", "entries": "array<bigint>", "exits": "array<bigint>", "last": "boolean", "cost": "long", "illegal": "long"},
    )
    # The segments of one conversation are searched wherever there is room.
    searched = _mapped(entered.repartition("conv_id", "at", "part"), _searched, kind, {"at": "long", "part": "long", "cost": "long", "illegal": "long", "ways": _WAYS})
    both = searched.unionByName(ordered.select("conv_id", "at", "role", "text", "copies"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at", F.col("ways").isNull(), "part")


def _with_copies(rows: DataFrame) -> DataFrame:
    return rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place, role, text, edit (K kept, R reroled, I inserted).  Cases as in repairs."""
    rows = rows.select("conv_id", "turn", "role", "text", F.lit(1).alias("copies"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _mapped(_solved(*_marked(rows)), _rows, kind, {"place": "long", "role": "string", "text": "string", "edit": "string"})


def repairs(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """The faults of every conversation and its cheapest repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.

    Args: rows with ``conv_id``, ``turn``, ``role``, ``text`` and, for rows that stand for more than one, ``copies``;
    originals with the ``conv_id`` of conversations that are to be told even if they have no rows.

    Defined cases: rows go by turn, nulls first, equal turns by role and text; a null role or text is one space, of which
    no role keeps; a null conv_id is a conversation; repeated rows are duplicates of the first; a conversation without
    rows has zeros, an empty audit and the hash of nothing; very long texts are hashed in full; an empty table gives no
    rows; other columns are ignored.
    """
    ordered, marked = _marked(_with_copies(rows))
    kind = ordered.schema["conv_id"].dataType.simpleString()
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))
    counts = marked.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    told = _mapped(_solved(ordered, marked), _digests, kind, {"cost": "long", "illegal": "long", "audit": "string", "repaired_sha256": "string"})
    names = (rows if originals is None else originals).select("conv_id").distinct()
    # Grouped, not joined: a null id is a key like others.
    both = names.unionByName(counts, allowMissingColumns=True).unionByName(told, allowMissingColumns=True).groupBy("conv_id")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return both.agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32 of ``conv_id:turn``: dropped, emptied, stripped of ends of sentences, repeated (two
    copies), given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fate.alias("fate")).where("fate != 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("copies"),
    )


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repairs(damaged(conversations), conversations)


_ORACLE = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(c ORDER BY n) AS tab FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(n))
), fated AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
    lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS fate
  FROM conversations, crc
), faulty AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, range(2) t(k) WHERE fate <> 0 AND (k = 0 OR fate = 3)
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS e FROM faulty
), seen AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen FROM placed
), marked AS MATERIALIZED (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS i, e = '' AS blank, e <> '' AND seen > 1 AS dup, e <> '' AND seen = 1 AND e NOT IN ('.', '!', '?') AS cut FROM seen
), go(q, nxt, who) AS (VALUES ('e', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')
), ins AS (
  SELECT q, q AS q2, 0 AS c, '' AS l, '' AS t FROM go UNION ALL SELECT q, nxt, 3, 'I', chr(10) || who || ':' FROM go
  UNION ALL SELECT a.q, b.nxt, 6, 'II', chr(10) || a.who || ':' || chr(10) || b.who || ':' FROM go a JOIN go b ON a.nxt = b.q
), best AS (
  SELECT conv_id, 0::BIGINT AS pos, ins.q2 AS q, {'c': ins.c::BIGINT, 'l': ins.l, 't': ins.t} AS m FROM (SELECT DISTINCT conv_id FROM marked), ins WHERE ins.q = 'e'
  UNION ALL
  SELECT conv_id, pos, q2, min({'c': c, 'l': l, 't': t}) FROM (
    SELECT w.conv_id, w.pos, ins.q2, w.c + ins.c AS c, w.l || ins.l AS l, w.t || ins.t AS t FROM (
      SELECT r.conv_id, r.pos, b.q, b.m.c + 4 AS c, b.m.l || 'D' AS l, b.m.t AS t FROM best b JOIN marked r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos + 1
      UNION ALL
      SELECT r.conv_id, r.pos, r.i, b.m.c + CASE WHEN r.cut THEN 3 ELSE 0 END, b.m.l || 'K', b.m.t || chr(10) || r.role || ':' || r.text FROM best b JOIN go ON go.q = b.q
        JOIN marked r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos + 1 WHERE NOT (r.blank OR r.dup) AND (r.i = go.nxt OR (r.i = 's' AND b.q = 'e'))
      UNION ALL
      SELECT r.conv_id, r.pos, go.nxt, b.m.c + CASE WHEN r.cut THEN 6 ELSE 3 END, b.m.l || 'R', b.m.t || chr(10) || go.who || ':' || r.text FROM best b JOIN go ON go.q = b.q
        JOIN marked r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos + 1 WHERE NOT (r.blank OR r.dup)
    ) w JOIN ins ON ins.q = w.q
  ) GROUP BY conv_id, pos, q2
), told AS (
  SELECT b.conv_id, min(b.m) AS m FROM best b JOIN (SELECT conv_id, max(pos) AS n FROM marked GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM b.conv_id AND z.n = b.pos WHERE b.q IN ('e', 'a') GROUP BY b.conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS dup, count(*) FILTER (cut) AS cut, count(*) FILTER (bad) AS bad
  FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i NOT IN ('su', 'ua', 'au') AS bad FROM marked) GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(dup, 0)::BIGINT AS duplicate, coalesce(cut, 0)::BIGINT AS truncated, coalesce(bad, 0)::BIGINT AS illegal,
  coalesce(m.c, 0)::BIGINT AS cost, coalesce(m.l, '') AS audit, sha256(coalesce(substr(m.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM o.conv_id
"""

QUERIES = {"op13_repair": op13_repair}
ORACLES = {"op13_repair": _ORACLE}
