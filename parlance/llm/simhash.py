"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints of 64 bits that differ in two bits at most agree, in one of their two halves, up to one
bit. Each half is indexed with each of its bits as a wildcard; equality of a variant makes candidates, which
are verified on all 64 bits. A bucket gives a spanning forest of its links, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined_hot, stored

DISTANCE = 2
SHINGLE = 3
SEED = 42


class Bounds(NamedTuple):
    """Sizes that decide how buckets are compared, never what is linked. They are sent with the work."""

    #: Buckets up to this size are compared as a matrix, beyond it by sorting under two-bit masks.
    matrix: int = 256
    #: Buckets beyond this size don't fit a task; their members are linked by two-wildcard variants instead.
    bucket: int = 1 << 20


def _fingerprint(raw: bytes, shingle: int) -> int:
    words = raw.lower().split()  # bytes: A-Z, and the six ASCII white-space characters
    n = len(words)
    if n == 0:
        return 0
    if n <= shingle:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        cuts = map(joined.__getitem__, map(slice, starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()))
        h = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(SEED)), np.uint64, n - shingle + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 64):  # sums of 255 rows fit a byte
        bits = np.unpackbits(h[at : at + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            total += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.int64)[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([_fingerprint((t.as_py() or "").encode(), SHINGLE) for t in texts], pa.int64())


def fingerprint(text: Column) -> Column:
    """The 64 bits as a signed long; a null text or one without words has zero."""
    return _fingerprints(text)


def variants(fps: DataFrame) -> DataFrame:
    """(variant, fp): 64 signatures of each fingerprint, half and wildcard bit above the half's other 31 bits."""
    half = lambda s: F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF))
    bits = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("w"))
    value = F.when(F.col("w") < 32, half(0)).otherwise(half(1))
    return bits.select(F.expr("shiftleft(cast(w as bigint), 32)").bitwiseOR(value.bitwiseAND(F.expr("~shiftleft(1L, w % 32)"))).alias("variant"), "fp")


def _labels(members: np.ndarray, masks: list[int]) -> np.ndarray:
    """For each member the place of the first one that it is linked to, under masks of two bits at most.

    Members that agree outside a mask differ in two bits at most: each such class is a clique.
    """
    label = np.arange(len(members))
    while True:
        before = label.copy()
        for mask in masks:
            v = members & np.uint64(~mask & 0xFFFFFFFFFFFFFFFF)
            order = np.argsort(v, kind="stable")
            first = np.concatenate([[True], np.diff(v[order]) != 0])
            at = np.flatnonzero(first)
            least = np.minimum.reduceat(label[order], at)
            label[order] = least[np.cumsum(first) - 1]
        label = label[label]
        if (label == before).all():
            return label


def bucket_links(members: np.ndarray, variant: int, matrix: int = Bounds().matrix) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) that connect just what the links inside a bucket connect; fewer than members."""
    if len(members) <= matrix:
        near = np.bitwise_count(members[:, None] ^ members[None, :]) <= DISTANCE
        label = np.arange(len(members))
        while True:
            least = np.where(near, label[None, :], len(members)).min(axis=1)
            if (least == label).all():
                break
            label = least
    else:
        w = variant >> 32
        other = range(32, 64) if w < 32 else range(32)
        masks = [1 << w | 1 << b for b in other]
        if w % 32 == 0:
            masks += [1 << a | 1 << b for a in other for b in other if a < b]
        label = _labels(members, masks)
    linked = np.flatnonzero(label != np.arange(len(members)))
    return members[linked], members[label[linked]]


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(bounds: Bounds):
    return lambda batches: _linked(batches, bounds)


def _linked(batches: Iterator[pa.RecordBatch], bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by variant. A row (fp, null) says that fp's bucket was beyond bounds.bucket."""
    held_v, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    spilled = None  # the variant of the bucket that is passed on whole

    def links(v, f):
        nonlocal spilled
        first = np.flatnonzero(np.concatenate([[True], np.diff(v) != 0]))
        size = np.diff(np.concatenate([first, [len(v)]]))
        two = first[size == 2]
        two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= DISTANCE]
        a, b = [f[two + 1]], [f[two]]
        for i in np.flatnonzero(size > 2).tolist():
            x, y = bucket_links(f[first[i] : first[i] + size[i]], int(v[first[i]]), bounds.matrix)
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.record_batch([pa.array(a), pa.array(b)], schema=_EDGE)

    for batch in batches:
        v = np.concatenate([held_v, batch.column(0).to_numpy()])
        f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
        if spilled is not None:
            n = int(np.searchsorted(v, spilled, "right"))
            yield pa.record_batch([pa.array(f[:n].view(np.int64)), pa.nulls(n, pa.int64())], schema=_EDGE)
            v, f = v[n:], f[n:]
            if not len(v):
                held_v, held_f = v, f
                continue
            spilled = None
        if not len(v):
            continue
        last = int(np.searchsorted(v, v[-1], "left"))  # the last bucket may go on in the next batch
        if last:
            yield links(v[:last], f[:last])
        held_v, held_f = v[last:], f[last:]
        if len(held_v) > bounds.bucket:
            spilled = held_v[0]
            yield pa.record_batch([pa.array(held_f.view(np.int64)), pa.nulls(len(held_f), pa.int64())], schema=_EDGE)
            held_v, held_f = held_v[:0], held_f[:0]
    if len(held_v):
        yield links(held_v, held_f)


def _wide_edges(fps: DataFrame) -> DataFrame:
    """Links among the members of oversized buckets: all that agree outside two bits are linked to the least of them."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda a: F.transform(F.sequence(a + 1, F.lit(63)), lambda b: F.struct(a.alias("x"), b.alias("y")))))
    rows = fps.select("fp", F.explode(pairs).alias("m"))
    rows = rows.select("fp", "m", F.expr("fp & ~(shiftleft(1L, m.x) | shiftleft(1L, m.y))").alias("v"))
    least = rows.groupBy("m", "v").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(least, ["m", "v"]).select(F.col("fp").alias("a"), "b").filter("a != b").distinct()


def links(fps: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """(a, b): links of distinct fingerprints (fp) whose connected components are those of all links."""
    sorted_ = variants(fps).repartition("variant").sortWithinPartitions("variant")
    found = stored(sorted_.mapInArrow(_edges(bounds), "a long, b long"), "links")
    wide = found.filter(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    narrow = found.filter(F.col("b").isNotNull()).distinct()
    return narrow if wide.isEmpty() else narrow.unionByName(_wide_edges(wide)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b): root is the least node of the component.

    Each round points every node to its least neighbour, follows the pointers by doubling to their ends, and
    contracts the edges; the rounds grow with the logarithm of the longest path.
    """
    roots = None
    edges = stored(edges.filter("a != b").select("a", "b"), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stored(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")), "pointers")
        while True:
            ends = point.select(F.col("a").alias("p"), F.col("p").alias("q"))
            following = stored(point.join(ends, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "pointers")
            point = following.select("a", "p")
            if following.filter("moved").isEmpty():
                break
        if roots is None:
            roots = point.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            up = point.select(F.col("a").alias("root"), "p")
            roots = roots.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        to_a, to_b = point.select("a", F.col("p").alias("x")), point.select(F.col("a").alias("b"), F.col("p").alias("y"))
        left = edges.join(to_a, "a").join(to_b, "b").filter("x != y")
        edges = stored(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) of each document; component_id is the least key reachable over links.

    Texts without words, null ones among them, share fingerprint zero and are linked like any other. Null keys
    take no part in the least key, and get null if a component has none other. Repeated rows each get a row, an
    empty table gives none. A text of any length is taken whole; other columns are left out, so names can't clash.
    """
    rows = stored(docs.select(F.col(key).alias("id"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.select("fp", "root", "copies").join(least, "root").select("fp", "copies", "component_id")
    return joined_hot(rows, of_fp, "fp", "copies").select(F.col("id").alias(key), "fp", "component_id")
