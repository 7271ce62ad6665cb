"""WARC archives with a two-level capture index.

Archives hold one gzip member for each record.  The index is a sorted list of captures (reversed-host URL key, place of
the record) in compressed blocks; a sparse directory holds the first key and the place of each block.  A lookup finds
the blocks of a key by binary search in the directory, reads their ranges, and then those of the records.  Files are
written by the tasks through the filesystem of the shared folder under names of their own; what a lost task leaves is
never referred to.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, joined, new_path, saved, table, with_prefix

DATE = "2000-01-01T00:00:00Z"
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 128 << 20
#: Captures in a block of the index.
BLOCK_LINES = 256
#: Directory rows in a part, which one task searches at a time, and parts in its root, which is broadcast, at most.
DIRECTORY_SLICE, ROOT = 512, 2_000_000
#: Payloads that occur more than once are told to the tasks by a broadcast up to this many; more are joined.
BROADCAST_PAYLOADS = 500_000
_ID = "urn:page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The sorting key of a URL: reversed host, then path and query, in lower case; whatever is no URL sorts as it is."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "://" in text else f"http://{text}")
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return quote(text.lower(), safe="/?&=%:,()")
    path = quote(parts.path or "/", safe="/%:,;@") + (f"?{quote(parts.query, safe='/?&=%:,')}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{port}){path.lower()}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record: the payload behind its HTTP header, or for a revisit that header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{_ID}{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%"),
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
    }
    if revisit:
        head |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": f"<{_ID}{'' if refers_to is None else refers_to}>"}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, payload's full length) of a record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, payload, int(re.search(rb"Content-Length: (\d+)", http)[1])


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    """The filesystem and path of a URI; object stores are known by the name that Hadoop gives them too."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


class _Files:
    """Appends to new files of a folder, and reads ranges of any."""

    def __init__(self, folder: str | None = None, suffix: str = ""):
        self.folder, self.suffix, self.out, self.at, self.open = folder, suffix, None, 0, {}

    def append(self, data: bytes, limit: int) -> tuple[str, int]:
        if self.out is None or self.at >= limit:
            self.close()
            system, path = _system(self.folder)
            system.create_dir(path, recursive=True)
            name = f"{uuid.uuid4().hex}{self.suffix}"
            self.out, self.name, self.at = system.open_output_stream(f"{path}/{name}", compression=None), f"{self.folder}/{name}", 0
        place = self.name, self.at
        self.out.write(data)
        self.at += len(data)
        return place

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) >= 64:
                self.close()
            system, path = _system(uri)
            self.open[uri] = system.open_input_file(path)
        return self.open[uri].read_at(length, offset)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        for x in self.open.values():
            x.close()
        self.out, self.open = None, {}


_CAPTURE = "urlkey string, page_id bigint, file string, offset bigint, length bigint"


def _written(batches, folder):
    files = _Files(folder, ".warc.gz")
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            data = gzip.compress(record(r["page_id"], r["url"], r["payload"] or b"", r["refers_to"], r["revisit"]), 5, mtime=0)
            file, offset = files.append(data, ARCHIVE_BYTES)
            rows.append({"urlkey": url_key(r["url"]), "page_id": r["page_id"], "file": file, "offset": offset, "length": len(data)})
        yield pa.RecordBatch.from_pylist(rows, _schema(_CAPTURE))
    files.close()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


_DIRECTORY = "first_key string, last_key string, file string, offset bigint, length bigint, lines int"


def _packed(batches, folder):
    files, lines, keys = _Files(folder, ".idx"), [], []

    def block():
        data = zlib.compress("\n".join(lines).encode(), 6)
        file, offset = files.append(data, ARCHIVE_BYTES)
        row = {"first_key": keys[0], "last_key": keys[-1], "file": file, "offset": offset, "length": len(data), "lines": len(lines)}
        lines.clear()
        keys.clear()
        return pa.RecordBatch.from_pylist([row], _schema(_DIRECTORY))

    for batch in batches:
        for r in batch.to_pylist():
            keys.append(r["urlkey"])
            lines.append(f"{r['urlkey']} {json.dumps({k: r[k] for k in ('page_id', 'file', 'offset', 'length')})}")
            if len(lines) == BLOCK_LINES:
                yield block()
    if lines:
        yield block()
    files.close()


def write_archives(pages: DataFrame, name: str = "warc") -> DataFrame:
    """Writes a record for every page into new archives in the shared folder, and the index over them.

    Args: pages with ``page_id``, ``url`` and ``html``.  Returns the directory of the index (first_key, last_key, file,
    offset, length, lines), a row per block.

    Of pages with equal payloads the one with the largest page_id is the response and the others revisit it.

    Defined cases: null or empty html is an empty payload like any other; a null page_id is smaller than all others;
    rows repeated with page_id and url are each a record, of the same type; a null url has the empty key; an empty
    table gives an empty directory; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = new_path(spark, name)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    # Only payloads that occur more than once need to know their response: often few, so that no page is shuffled.
    last = F.max(F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("o"), F.coalesce("url", F.lit("")).alias("u"))).alias("last")
    many = rows.groupBy("digest").agg(F.count("*").alias("n"), last, F.max("page_id").alias("first_id")).where("n > 1")
    many = saved(many.select("digest", "last", F.col("first_id").alias("refers_to")), "payloads")
    own = F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("o"), F.coalesce("url", F.lit("")).alias("u"))
    rows = joined(rows, many, "digest", BROADCAST_PAYLOADS, "left")
    rows = rows.select("page_id", "url", "payload", "refers_to", (F.col("last").isNotNull() & (own != F.col("last"))).alias("revisit"))
    captures = saved(rows.mapInArrow(lambda b: _written(b, folder), _CAPTURE), "captures")
    ordered = captures.repartitionByRange("urlkey", "page_id", "file", "offset").sortWithinPartitions("urlkey", "page_id", "file", "offset")
    return saved(ordered.mapInArrow(lambda b: _packed(b, folder), _DIRECTORY), "directory")


_RECORD = "urlkey string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _number(text: str | None) -> int | None:
    digits = (text or "").strip("<>").removeprefix(_ID)
    return int(digits) if digits else None


def _fetched(files: _Files, line: str) -> dict:
    """Reads the record of a line of the index and checks it against its digest."""
    key, _, place = line.rpartition(" {")
    place = json.loads("{" + place)
    headers, payload, size = parse(gzip.decompress(files.read(place["file"], place["offset"], place["length"])))
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if kind == "response" and (payload_digest(payload) != digest or len(payload) != size):
        raise ValueError(f"the record of page {place['page_id']} is damaged")
    return {
        "urlkey": key, "page_id": _number(headers["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": _number(headers.get("WARC-Refers-To")) if kind == "revisit" else None,
    }


def _block_lines(files: _Files, row: dict) -> list[str]:
    return zlib.decompress(files.read(row["file"], row["offset"], row["length"])).decode().split("\n")


def _read(batches):
    files = _Files()
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pylist([_fetched(files, x) for x in _block_lines(files, row)], _schema(_RECORD))
    files.close()


def read_archives(directory: DataFrame) -> DataFrame:
    """All records, block by block of the index: urlkey, page_id, payload_bytes, payload_digest, record_type, refers_to.

    Defined cases: a row for each record that was written, repeated rows included; an empty directory gives no rows; a
    record that does not match its digest raises an error.
    """
    tasks = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: rows are small, the work behind them is not
    return directory.repartition(tasks, F.col("file"), F.col("offset")).mapInArrow(_read, _RECORD)


_PLACE = "urlkey string, file string, offset bigint, length bigint"
_SLOTTED = "slot bigint, urlkey string"


def _covering(ends: list[tuple[str, str]], key: str):
    """The places of the sorted ranges (first, last) that hold a key, by binary search."""
    at = bisect.bisect_left(ends, key, key=lambda e: e[1])
    while at < len(ends) and ends[at][0] <= key:
        yield at
        at += 1


def _slotted(batches, root):
    """The parts of the directory that may hold each key, by binary search in its root."""
    ends = root.value
    for batch in batches:
        found = [(slot, key) for key in batch.column("urlkey").to_pylist() for slot in _covering(ends, key)]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([k for _, k in found], pa.string())], ["slot", "urlkey"])


def _searched(batches):
    """The blocks that may hold each key, by binary search in its part of the directory; a part's rows come before its keys."""
    slot, rows, ends = None, [], []
    for batch in batches:
        hits = []
        for r in batch.to_pylist():
            if r["file"] is not None:
                if r["slot"] != slot:
                    slot, rows, ends = r["slot"], [], []
                rows.append(r)
                ends.append((r["first_key"], r["last_key"]))
                continue
            for at in _covering(ends, r["urlkey"]) if r["slot"] == slot else ():
                hits.append({"urlkey": r["urlkey"], **{k: rows[at][k] for k in ("file", "offset", "length")}})
                if len(hits) >= BLOCK_LINES:
                    yield pa.RecordBatch.from_pylist(hits, _schema(_PLACE))
                    hits = []
        yield pa.RecordBatch.from_pylist(hits, _schema(_PLACE))


def _records(batches):
    """The records of the wanted keys of each block; rows of one block follow one another, and it is read once."""
    files, block, wanted = _Files(), None, set()

    def hits():
        lines = [x for x in _block_lines(files, block) if x.rpartition(" {")[0] in wanted] if block else []
        return pa.RecordBatch.from_pylist([_fetched(files, x) for x in lines], _schema(_RECORD))

    for batch in batches:
        for row in batch.to_pylist():
            if block is None or (row["file"], row["offset"]) != (block["file"], block["offset"]):
                yield hits()
                block, wanted = row, set()
            wanted.add(row["urlkey"])
    yield hits()
    files.close()


def _keyed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(x) for x in batch.column(0).to_pylist()], pa.string())], ["urlkey"])


def lookup(directory: DataFrame, urls: DataFrame) -> DataFrame:
    """The records of the given urls (column ``url``): binary search in the directory, then range reads.

    The directory's root, the ends of every DIRECTORY_SLICE rows of it, is broadcast and tells each key its part; keys then meet the
    rows of their part in its task.  Blocks that were found are dealt over tasks, so the captures of one url may be in as many
    blocks as they need.

    Defined cases: a url that was never captured has no row; repeated urls, and urls with one key, are looked up once; a
    null url has the empty key; very long payloads are read whole, one at a time; an empty directory and an empty table give no
    rows.
    """
    spark = directory.sparkSession
    keys = urls.select(F.coalesce("url", F.lit("")).alias("url")).distinct().mapInArrow(_keyed, "urlkey string").distinct()
    ranked = saved(with_prefix(directory, [F.col("first_key").asc(), F.col("last_key").asc()], {}, "directory"), "ranked")
    parts = ranked.select(F.expr(f"row div {DIRECTORY_SLICE}").alias("slot"), "row", "first_key", "last_key", "file", "offset", "length")
    ends = parts.groupBy("slot").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"))
    if not at_most(ends, ROOT):
        raise ValueError(f"over {ROOT} parts of the directory")
    root = spark.sparkContext.broadcast([(r["first"], r["last"]) for r in ends.orderBy("slot").collect()])
    wanted = keys.mapInArrow(lambda b: _slotted(b, root), _SLOTTED)
    both = parts.unionByName(wanted, allowMissingColumns=True).repartition("slot").sortWithinPartitions("slot", F.col("row").asc_nulls_last())
    places = both.mapInArrow(_searched, _PLACE)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_records, _RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return lookup(write_archives(pages), pages).drop("urlkey")


QUERIES = {"op8_warc": op8_warc}
#: DuckDB has no base32; the tests check the round trip byte by byte.
ORACLES: dict[str, str] = {}
