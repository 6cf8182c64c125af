"""Benchmark decontamination.

The n-grams of the benchmark become a hash set of flat arrays that is broadcast while its size, which is checked first, is within a
bound; token windows of the documents are probed against it, hits are verified on the words themselves, and spans
or documents are removed. A benchmark beyond the bound takes a join of windows by their hash instead, behind a bitmap of
fixed size that few others pass; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, Powers, joined_hot, slices, stored, utf8, window_hashes, word_bounds, word_hashes

N = 10
#: The set of n-grams is broadcast up to so many bytes.
MAX_BROADCAST_BYTES = 32 << 20
#: Bytes of the set for each word of the benchmark, besides its text: a hash, a place, an item, and the bitmap's share.
WORD_BYTES = 40
#: The bitmap of the join has 2 ** BITS bits.
BITS = 28
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPAN = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
HITS = T.StructType().add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("spans", _SPAN)
_HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def _windows(texts: pa.Array, n: int):
    """Of benchmark texts: their words as bytes, one space between two, and for each k the (hash, start, end, row) of windows of k words."""
    data, offsets = utf8(texts)
    data = ASCII_LOWER[data]
    s, e, row = word_bounds(data, offsets, _INSIDE)
    size = e - s
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    spaced = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    shift = np.repeat(starts - s, size)
    at = np.arange(len(shift)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s, size)
    spaced[at + shift] = data[at]
    h = word_hashes(data, s, e, Powers())
    counts = np.bincount(row, minlength=len(texts)) if len(row) else np.zeros(len(texts), np.int64)
    first = np.cumsum(counts) - counts
    found = {}
    for k in sorted({min(n, int(c)) for c in np.unique(counts) if c}):
        w = window_hashes(h, k)
        if k == n:
            at = np.flatnonzero(row[: len(w)] == row[k - 1 :])
        else:
            at = first[counts == k]
        found[k] = (w[at], starts[at], ends[at + k - 1], row[at])
    return spaced, found


class NgramSet:
    """Windows of the items in flat arrays: sorted hashes, and for each the place of its words in one buffer and its item."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        spaced, found = _windows(pa.array([t for _, t in items], pa.string()), n)
        self.words, self.names = spaced.tobytes(), [i for i, _ in items]
        self.sets = {}
        for k, (hashes, starts, ends, row) in found.items():
            order = np.lexsort((row, hashes))
            keys = hashes[order]
            size = 1 << min(25, max(20, int(8 * len(keys)).bit_length()))
            bitmap = np.zeros(size, bool)
            bitmap[keys & np.uint64(size - 1)] = True
            self.sets[k] = (keys, bitmap, np.uint64(size - 1), starts[order], ends[order].astype(np.int32) - starts[order].astype(np.int32), row[order].astype(np.int32))

    def items(self, k: int, low: int, high: int, window: bytes) -> set | None:
        """The items of the entries that have these words; None if there is none."""
        _, _, _, start, size, item = self.sets[k]
        found = None
        for i in range(low, high):
            if size[i] == len(window) and self.words[start[i] : start[i] + size[i]] == window:
                found = found or set()
                found.add(self.names[item[i]])
        return found


def _spans(s: np.ndarray, e: np.ndarray, row: np.ndarray, covered: np.ndarray, offsets: np.ndarray) -> list[list]:
    """Merged byte spans of the covered words of each row."""
    spans: list[list] = [[] for _ in range(len(offsets) - 1)]
    c = np.flatnonzero(covered)
    if len(c):
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(c) > 1) | (np.diff(row[c]) > 0)]))
        for a, b in zip(c[begins].tolist(), c[np.concatenate([begins[1:], [len(c)]]) - 1].tolist(), strict=True):
            r = int(row[a])
            spans[r].append({"start": int(s[a] - offsets[r]), "end": int(e[b] - offsets[r])})
    return spans


def _probe(grams: NgramSet, data: np.ndarray, offsets: np.ndarray, powers: Powers):
    """For a slice of rows: words, hit words, items and merged byte spans of each row."""
    rows = len(offsets) - 1
    data = ASCII_LOWER[data]
    s, e, row = word_bounds(data, offsets, _INSIDE)
    n_words = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    items: list[set] = [set() for _ in range(rows)]
    covered = np.zeros(len(s), bool)
    if len(s) and grams.sets:
        h = word_hashes(data, s, e, powers)
        for k, (keys, bitmap, mask, *_) in grams.sets.items():
            w = window_hashes(h, k)
            at = np.flatnonzero(bitmap[w & mask])
            if not len(at):
                continue
            at = at[row[at] == row[at + k - 1]]
            low = np.searchsorted(keys, w[at])
            known = keys[np.minimum(low, len(keys) - 1)] == w[at]
            at, low = at[known], low[known]
            high = np.searchsorted(keys, w[at], "right")
            for i, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                window = b" ".join(data[x:y].tobytes() for x, y in zip(s[i : i + k].tolist(), e[i : i + k].tolist(), strict=True))
                ids = grams.items(k, a, b, window)  # the words decide, not their hash
                if ids is not None:
                    covered[i : i + k] = True
                    items[row[i]] |= ids
    n_hit = np.bincount(row[covered], minlength=rows) if len(row) else np.zeros(rows, np.int64)
    return n_words, n_hit, [sorted(x for x in i if x is not None) for i in items], _spans(s, e, row, covered, offsets)


def hits_udf(benchmark: DataFrame, n: int = N, item: str = "item_id", text: str = "text") -> Callable[[Column], Column]:
    """A Column function text -> HITS, item ids as strings. The caller has checked the size of the benchmark (see fits)."""
    spark = benchmark.sparkSession
    grams = spark.sparkContext.broadcast(NgramSet([tuple(r) for r in benchmark.select(F.col(item).cast("string"), text).collect()], n))

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        powers, out = Powers(), []
        for a, b in slices(offsets):
            words, hit, ids, spans = _probe(grams.value, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], powers)
            out += [{"n_words": w, "n_hit": h, "items": i, "spans": x} for w, h, i, x in zip(words.tolist(), hit.tolist(), ids, spans, strict=True)]
        return pa.array(out, _HITS)

    return hits


def fits(benchmark: DataFrame, text: str = "text", most: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether the set of the benchmark's n-grams is small enough to broadcast, by its bytes and words."""
    words = F.size(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)))
    return (benchmark.agg(F.sum(F.octet_length(text) + words * WORD_BYTES)).first()[0] or 0) <= most


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, cut in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if cut:
            raw, kept, at = t.encode(), [], 0
            for x in cut:
                kept.append(raw[at : x["start"]])
                at = x["end"]
            t = b"".join([*kept, raw[at:]]).decode()
        out.append(t)
    return pa.array(out, pa.string())


GRAM = "item string, k int, hash long, words binary"
_GRAM = pa.schema([("item", pa.string()), ("k", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())])


def _grams(n: int):
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaced, found = _windows(batch.column(1), n)
            raw = spaced.tobytes()
            for k, (hashes, starts, ends, row) in found.items():
                for at in range(0, len(row), 10_000):
                    part = slice(at, at + 10_000)
                    words = [raw[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
                    yield pa.record_batch([batch.column(0).take(pa.array(row[part])), pa.array(np.full(len(words), k, np.int32)), pa.array(hashes[part].view(np.int64)), pa.array(words, pa.binary())], schema=_GRAM)

    return grams


PROBE = "row long, n_words long, pos int, k int, hash long, words binary"
_PROBE = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("pos", pa.int32()), ("k", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())])


def _probes(bitmap, sizes: list[int]):
    """Of (row, text): a row with the number of words, and the windows that pass the bitmap."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = Powers(), np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            name = batch.column(0).to_numpy()
            for a, b in slices(offsets):
                own, rows = ASCII_LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
                s, e, row = word_bounds(own, rows, _INSIDE)
                counts = np.bincount(row, minlength=b - a) if len(row) else np.zeros(b - a, np.int64)
                none = pa.nulls(b - a, pa.int32())
                yield pa.record_batch([pa.array(name[a:b]), pa.array(counts), none, none, pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.binary())], schema=_PROBE)
                h = word_hashes(own, s, e, powers)
                begin = np.cumsum(counts) - counts
                for k in sizes:
                    w = window_hashes(h, k)
                    place = w >> np.uint64(64 - BITS)
                    at = np.flatnonzero(bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1))
                    at = at[row[at] == row[at + k - 1]]
                    for i in range(0, len(at), 10_000):
                        part = at[i : i + 10_000]
                        words = [b" ".join(own[x:y].tobytes() for x, y in zip(s[j : j + k].tolist(), e[j : j + k].tolist(), strict=True)) for j in part.tolist()]
                        r = row[part]
                        yield pa.record_batch([pa.array(name[a:b][r]), pa.nulls(len(part), pa.int64()), pa.array((part - begin[r]).astype(np.int32)), pa.array(np.full(len(part), k, np.int32)), pa.array(w[part].view(np.int64)), pa.array(words, pa.binary())], schema=_PROBE)

    return probes


@F.arrow_udf(_SPAN)
def _byte_spans(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    """Byte spans of ranges of words (first, last + 1) that don't touch."""
    out = []
    for t, own in zip(texts, ranges.to_pylist(), strict=True):
        data, offsets = utf8(pa.array([t.as_py()], pa.string()))
        s, e, _ = word_bounds(ASCII_LOWER[data], offsets, _INSIDE)
        out.append([{"start": int(s[r["a"]]), "end": int(e[r["b"] - 1])} for r in own or []])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def _bitmap(grams: DataFrame) -> bytes:
    """2 ** BITS bits, those of the grams' hashes set: 2 ** (BITS - 6) numbers at most come to the driver."""
    place = F.shiftrightunsigned("hash", 64 - BITS)
    words = grams.select(F.shiftrightunsigned(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITS}) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.tobytes()


def _joined(rows: DataFrame, benchmark: DataFrame, n: int, item: str, item_text: str) -> DataFrame:
    """(row, n_words, n_hit, items, ranges) of documents (row, text): ranges of hit words (a, b), merged."""
    spark = rows.sparkSession
    grams = stored(benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).mapInArrow(_grams(n), GRAM), "grams")
    sizes = sorted(r[0] for r in grams.select("k").distinct().collect())  # n values at most
    found = stored(rows.mapInArrow(_probes(spark.sparkContext.broadcast(_bitmap(grams)), sizes), PROBE), "probes")
    counts = found.filter(F.col("n_words").isNotNull()).select("row", "n_words")
    # a window is known by its digest from here on
    gram = F.struct("k", F.md5("words").alias("digest"))
    distinct = grams.select("hash", "k", "words").distinct()
    place = F.struct("hash", "k", "words").alias("window")
    probes = stored(found.filter(F.col("pos").isNotNull()).select("row", "pos", place), "windows")
    # a popular window is in very many documents: those are met by a broadcast
    own = probes.groupBy("window").agg(F.count("*").alias("n")).join(distinct.select(place), "window")
    hits = stored(joined_hot(probes, own, "window", "n").select("row", "pos", "window.*").select("row", "pos", "k", gram.alias("gram")), "hits")
    merged = F.expr("""aggregate(array_sort(collect_set(struct(pos as a, pos + k as b))), cast(array() as array<struct<a: int, b: int>>), (acc, x) ->
        case when size(acc) > 0 and x.a <= element_at(acc, -1).b
             then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).a as a, greatest(x.b, element_at(acc, -1).b) as b)))
             else concat(acc, array(x)) end)""")
    ranges = hits.groupBy("row").agg(merged.alias("ranges"))
    named = grams.select(gram.alias("gram"), "item").filter("item is not null").distinct()
    items = hits.select("row", "gram").distinct().join(named, "gram").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, r: acc + r["b"] - r["a"])
    out = counts.join(ranges, "row", "left").join(items, "row", "left")
    return out.select("row", "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "ranges")


def _free_name(df: DataFrame) -> str:
    name = "_row"
    while name in df.columns:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a number for each row, so that rows that repeat or have no key are told apart; and its column."""
    row = _free_name(docs)
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, key: str = "doc_id", text: str = "text", item: str = "item_id", most: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(key, n_words, n_hit, items) of each document, items being the item ids in their order.

    A window is n consecutive words of an item, or the whole item if it has fewer (none: no window). A word of
    a document inside any occurrence of a window is hit. A null or empty text has no words; a null item_id
    hits but isn't listed; repeated rows each get a row, those without a key too; an empty table gives no rows, an empty benchmark no
    hits; texts of any length are read whole; other columns are left out, so names can't clash.
    """
    kind = benchmark.schema[item].dataType
    ids = lambda c: F.array_sort(F.transform(c, lambda i: i.cast(kind)))
    if fits(benchmark, most=most):
        found = docs.select(key, hits_udf(benchmark, n, item)(F.col(text)).alias("_h"))
        return found.select(key, "_h.n_words", "_h.n_hit", ids(F.col("_h.items")).alias("items"))
    rows, row = _numbered(docs.select(key, text))
    found = _joined(rows.select(F.col(row).alias("row"), F.col(text).alias("text")), benchmark, n, item, "text")
    return rows.select(key, F.col(row).alias("row")).join(found, "row").select(key, "n_words", "n_hit", ids(F.col("items")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N, text: str = "text", item: str = "item_id", most: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs, all columns kept, without the contaminated documents or (remove="spans") without the hit words.

    Each row is judged by itself: nulls, repeated rows and the rest as in contamination.
    """
    if fits(benchmark, most=most):
        hits = hits_udf(benchmark, n, item)
        if remove == "documents":
            return docs.filter(hits(F.col(text))["n_hit"] == 0)
        return docs.withColumn(text, _without(F.col(text), hits(F.col(text))["spans"]))
    rows, row = _numbered(docs)
    found = _joined(rows.select(F.col(row).alias("row"), F.col(text).alias("text")), benchmark, n, item, "text").filter("n_hit > 0")
    if remove == "documents":
        return rows.join(found.select(F.col("row").alias(row)), row, "left_anti").select(docs.columns)
    ranges = _free_name(rows) + "ranges"
    cut = rows.join(found.select(F.col("row").alias(row), F.col("ranges").alias(ranges)), row, "left")
    return cut.withColumn(text, _without(F.col(text), _byte_spans(F.col(text), F.col(ranges)))).select(docs.columns)
