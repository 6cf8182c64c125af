"""WARC archives with a two-level capture index.

Archives are rows of a written table, each a run of gzip members with one record each, so they lie in any
store that Spark writes to; a volume is what one task wrote. The index sorts reversed-host keys into compressed blocks; a sparse
directory has the first entry of each block. A request is searched in the directory, then in its block; of the archives, only volumes with
hits are read, where they lie while the hits are few, and records are cut out by their byte range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_SHARE, shared_folder, stored

#: Equal payloads from this size on are stored once.
LEAST_SHARED = 1000


class Bounds(NamedTuple):
    """Sizes that decide how archives and their index are written and read, never what is found. They are sent with the work."""

    #: An archive is closed at this size or number of records, a block of the index at this number of entries.
    archive_bytes: int = 1 << 20
    archive_records: int = 256
    block_entries: int = 1024
    #: The directory is broadcast up to this size; beyond it the bounds of its parts are, which have an eighth of this size.
    directory_bytes: int = 32 << 20
    #: Up to so many ranges are broadcast to where archives are read; beyond it archives and ranges are joined.
    few_hits: int = 1000


_NULL = -(1 << 63)

ENTRY = T.StructType().add("key", "string").add("page_id", "long").add("offset", "long").add("length", "integer")
ARCHIVE = T.StructType().add("archive", "integer").add("data", "binary").add("entries", T.ArrayType(ENTRY)).add("volume", "integer")
BLOCK = T.StructType().add("block_id", "string").add("first_key", "string").add("first_page", "long").add("n", "integer").add("body", "binary")
RECORD = T.StructType().add("page_id", "long").add("record_type", "string").add("refers_to", "long").add("url", "string").add("payload_bytes", "long").add("payload_digest", "string").add("payload", "binary")


def surt(url: Column) -> Column:
    """The key of a URL: host labels reversed, then the rest without its fragment; a null URL has an empty key."""
    url = F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1))
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.when(url == "", F.lit("")).otherwise(F.regexp_replace(key, r"[\x00-\x20\x7F]", "%20"))


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, key, payload, digest, refers_to): refers_to is null for what is stored as a response.

    Of equal payloads of LEAST_SHARED bytes or more the one with the largest id is stored (all rows with that
    id, if it repeats); one without an id refers to it too, and is stored if there is no id at all. A popular payload is looked up by a
    broadcast; pages with smaller payloads, which nothing refers to, are dealt by their ids.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), surt(F.col(url)).alias("key"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = F.octet_length("payload") >= LEAST_SHARED
    found = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    shared = stored(found, "shared")
    popular = max(1000.0, HOT_SHARE * (shared.agg(F.sum("n")).first()[0] or 0))
    hot = F.broadcast(shared.filter(F.col("n") > popular).select("digest", F.col("last").alias("_hot"), F.lit(True).alias("_known")))
    cold = shared.filter(F.col("n") <= popular).select(F.col("digest").alias("_digest"), "last")
    rows = rows.join(hot, "digest", "left")
    own = F.when(large & F.col("_known").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url")))
    rows = rows.withColumn("_digest", own).join(cold, "_digest", "left").withColumn("last", F.when(F.col("_known"), F.col("_hot")).otherwise(F.col("last")))
    refers = F.when(large & ~F.col("last").eqNullSafe(F.col("page_id")), F.col("last"))
    return rows.select("page_id", "url", "key", "payload", "digest", refers.alias("refers_to"))


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _line(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def capture_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        headers.append(("WARC-Target-URI", _line(url)))
    headers.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    headers.append(("Content-Type", "application/http; msgtype=response"))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return _record(headers, http)
    return _record(headers, http + payload)


def read_record(member: bytes) -> dict:
    """RECORD of a gzip member; ValueError if the payload doesn't have its digest."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda name: int(x) if (x := fields.get(name, "")[len("<urn:page:") : -1]) else None
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError("a payload differs from its digest")
    return {"page_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "payload": payload if fields["WARC-Type"] == "response" else None}


_ARCHIVE = pa.schema([("archive", pa.int32()), ("data", pa.binary()), ("entries", pa.list_(pa.struct([("key", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int32())]))), ("volume", pa.int32())])


def _archived(bounds: Bounds):
    return lambda batches: _filled(batches, bounds)


def _filled(batches: Iterator[pa.RecordBatch], bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """Archives of captures, with the places of their records."""
    task, seq = TaskContext.get().partitionId(), 0

    def info():
        return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{task}-{seq}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: parlance\r\n")

    parts, entries = [info()], []
    size = len(parts[0])

    def closed():
        return pa.RecordBatch.from_pylist([{"archive": seq, "data": b"".join(parts), "entries": entries, "volume": task}], schema=_ARCHIVE)

    for batch in batches:
        columns = [batch.column(i) for i in range(6)]
        for i in range(batch.num_rows):
            page_id, url, key, payload, digest, refers_to = (c[i].as_py() for c in columns)
            member = capture_record(page_id, url, payload, digest, refers_to)
            entries.append({"key": key, "page_id": page_id, "offset": size, "length": len(member)})
            parts.append(member)
            size += len(member)
            if size >= bounds.archive_bytes or len(entries) >= bounds.archive_records:
                yield closed()
                seq += 1
                parts, entries = [info()], []
                size = len(parts[0])
    if entries:
        yield closed()


_BLOCK = pa.schema([("block_id", pa.string()), ("first_key", pa.string()), ("first_page", pa.int64()), ("n", pa.int32()), ("body", pa.binary())])


def _blocks(entries: int):
    return lambda batches: _packed(batches, entries)


def _packed(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """Compressed blocks of so many sorted index rows."""
    task, seq, rows = TaskContext.get().partitionId(), 0, []

    def closed(own):
        body = "\n".join("\t".join("" if x is None else str(x) for x in r) for r in own)
        return pa.RecordBatch.from_pylist([{"block_id": f"{task}-{seq}", "first_key": own[0][0], "first_page": own[0][1], "n": len(own), "body": zlib.compress(body.encode())}], schema=_BLOCK)

    for batch in batches:
        rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        while len(rows) >= entries:
            yield closed(rows[:entries])
            seq, rows = seq + 1, rows[entries:]
    if rows:
        yield closed(rows)


@dataclass
class Collection:
    """Written archives (ARCHIVE) and the blocks of their index (BLOCK)."""

    archives: DataFrame
    blocks: DataFrame


def write(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", bounds: Bounds = Bounds()) -> Collection:
    """Archives all pages in the shared folder and indexes them. Null texts are empty payloads; every row has a record; no pages
    give no archives; other columns are left out, so names can't clash. An archive has a page of any size whole."""
    path = shared_folder(pages.sparkSession, "archives")
    captures(pages, key, url, html).mapInArrow(_archived(bounds), ARCHIVE).write.partitionBy("volume").parquet(path)
    archives = pages.sparkSession.read.schema(ARCHIVE).parquet(path)
    entries = archives.select("volume", "archive", F.explode("entries").alias("e")).select("e.key", "e.page_id", "volume", "archive", "e.offset", "e.length")
    order = ["key", "page_id", "volume", "archive", "offset"]
    blocks = stored(entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(bounds.block_entries), BLOCK), "index")
    return Collection(archives, blocks)


def _place(page: int | None) -> int:
    return _NULL if page is None else page


def _found_blocks(requests: DataFrame, blocks: DataFrame, most: int) -> DataFrame:
    """(key, page_id, block_id): the blocks that may hold a request, by binary search in the directory."""
    spark = requests.sparkSession
    directory = blocks.select("first_key", "first_page", "block_id")
    size, n = directory.agg(F.sum(F.octet_length("first_key") + 64), F.count("*")).first()
    if not n:
        return requests.select("key", "page_id", F.lit(None).cast("string").alias("block_id")).limit(0)
    if size > most:  # the bounds of sorted parts are searched first, then each part with its own requests
        spread = directory.repartitionByRange(int(-(-8 * size // most)), "first_key", "first_page").withColumn("part", F.spark_partition_id().cast("long"))
        directory = stored(spread, "directory")
        parts = sorted(((r.k.encode(), _place(r.p)), r.part) for r in directory.groupBy("part").agg(F.min(F.struct(F.col("first_key").alias("k"), F.col("first_page").alias("p"))).alias("m")).select("part", "m.k", "m.p").collect())
        routed = requests.select("key", "page_id", F.explode(_searcher(spark, parts, T.LongType(), pa.int64())(F.col("key"), F.col("page_id"))).alias("part"))
        return routed.groupBy("part").cogroup(directory.groupBy("part")).applyInArrow(_in_part, FOUND)
    rows = sorted((((r.first_key or "").encode(), _place(r.first_page)), r.block_id) for r in directory.collect())
    return requests.select("key", "page_id", F.explode(_searcher(spark, rows, T.StringType(), pa.string())(F.col("key"), F.col("page_id"))).alias("block_id"))


def _searcher(spark, rows: list, kind: T.DataType, arrow: pa.DataType):
    """A Column function (key, page_id) -> the names of the sorted rows from the last below the request to the last not above it."""
    held = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

    @F.arrow_udf(T.ArrayType(kind))
    def search(keys: pa.Array, pages: pa.Array) -> pa.Array:
        firsts, names = held.value
        out = []
        for k, p in zip(keys.to_pylist(), pages.to_pylist(), strict=True):
            mine = (k.encode(), _place(p))
            out.append(names[max(0, bisect_left(firsts, mine) - 1) : bisect_right(firsts, mine)])
        return pa.array(out, pa.list_(arrow))

    return search


FOUND = "key string, page_id long, block_id string"
_FOUND = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("block_id", pa.string())])


def _in_part(requests: pa.Table, directory: pa.Table) -> pa.Table:
    """The blocks that may hold a request, by binary search in the sorted rows of a part of the directory."""
    rows = sorted(zip(((k.encode(), _place(p)) for k, p in zip(directory["first_key"].to_pylist(), directory["first_page"].to_pylist(), strict=True)), directory["block_id"].to_pylist(), strict=True))
    firsts, out = [r[0] for r in rows], []
    for k, p in zip(requests["key"].to_pylist(), requests["page_id"].to_pylist(), strict=True):
        mine = (k.encode(), _place(p))
        out += [(k, p, name) for _, name in rows[max(0, bisect_left(firsts, mine) - 1) : bisect_right(firsts, mine)]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 3, _FOUND, strict=True)], schema=_FOUND)


_HIT = pa.schema([("page_id", pa.int64()), ("volume", pa.int32()), ("archive", pa.int32()), ("offset", pa.int64()), ("length", pa.int32())])
HIT = "page_id long, volume int, archive int, offset long, length int"


def _in_block(requests: pa.Table, blocks: pa.Table) -> pa.Table:
    out = []
    if requests.num_rows and blocks.num_rows:
        rows = [line.split("\t") for line in zlib.decompress(blocks["body"][0].as_py()).decode().split("\n")]
        keys = [(r[0].encode(), int(r[1] or _NULL)) for r in rows]
        for k, p in zip(requests["key"].to_pylist(), requests["page_id"].to_pylist(), strict=True):
            mine = (k.encode(), _place(p))
            for r in rows[bisect_left(keys, mine) : bisect_right(keys, mine)]:
                out.append({"page_id": p, "volume": int(r[2]), "archive": int(r[3]), "offset": int(r[4]), "length": int(r[5])})
    return pa.Table.from_pylist(out, schema=_HIT)


_RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _ranges(payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ranges in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = memoryview(data.as_buffer())
                records = (read_record(data[r["offset"] : r["offset"] + r["length"]]) for r in ranges)
                yield pa.RecordBatch.from_pylist([r if payload else r | {"payload": None} for r in records], schema=_RECORD)

    return read


def lookup(collection: Collection, requests: DataFrame, payload: bool = True, bounds: Bounds = Bounds()) -> DataFrame:
    """RECORD of all captures of the requests (key, page_id); payload=False leaves the payloads out.

    Requests that repeat count once, those that aren't archived give no row, no requests give none; a null page_id asks for captures
    without an id. A group of work is a block or an archive with its requests, which its entries bound.
    """
    asked = requests.select(F.coalesce("key", F.lit("")).alias("key"), "page_id").distinct()
    found = _found_blocks(asked, collection.blocks, bounds.directory_bytes)
    blocks = collection.blocks.select("block_id", "body")
    hits = found.groupBy("block_id").cogroup(blocks.groupBy("block_id")).applyInArrow(_in_block, HIT)
    wanted = stored(hits.groupBy("volume", "archive").agg(F.collect_list(F.struct("offset", "length")).alias("ranges")), "hits")
    archives = collection.archives.select("volume", "archive", "data")
    if (wanted.agg(F.sum(F.size("ranges"))).first()[0] or 0) <= bounds.few_hits:  # read where they lie, only the volumes that have them
        volumes = [r[0] for r in wanted.select("volume").distinct().collect()]  # few_hits at most
        archives, wanted = archives.filter(F.col("volume").isin(volumes)), F.broadcast(wanted)
    return archives.join(wanted, ["volume", "archive"]).select("data", "ranges").mapInArrow(_ranges(payload), RECORD)
