"""Near copies by the similarity of their word shingles, found over wide SimHash signatures.

A similarity of 0.8 is far beyond the few bits that fixed halves can cover, so a signature is cut into 21
segments of three bytes, of which one differs by at most one bit with a high chance: 0.91 for two texts that are just
0.8 alike, 0.98 at 0.85 and more above. From 2 ** 29 signatures on it has 75 segments of four bytes, with the same chances, so that
strangers don't fill the segments' values. Rows are dealt by the equal bytes of a segment; in the task one byte is
compared with each of its bits as a wildcard. What is found so is verified on the shingles themselves.

Runs of equal variants give a spanning forest of nearest neighbours, never all of their pairs. A run that is too long is
put in order by the members' sketches and cut into blocks, eight times, from another bit on each time: two members that are near
begin alike from one of these bits. Keys that hold a share of all signatures are dealt to several tasks by hash; what one segment parts so, the others can join.

All of this makes the first groups. An exact search follows for the links that chance, blocks and forests leave out: in one
order of all shingles, popular ones last, two sets that are similar enough share one of their first shingles. Texts of different groups that
share one are compared, however many do: popular shingles are dealt to cells in which each pair meets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, WORDS_BY_SPACE, Powers, joined_hot, mixed, released, slices, stored, utf8, window_hashes, word_bounds, word_hashes
from .simhash import components

SHINGLE = 5
SIMILARITY = 0.8
#: Candidates differ in so many bits of the 64 of their sketches at most; at a similarity of 0.8 these are 10 on average, 21 or more in one pair of 10000.
NEAR = 20


class Layout(NamedTuple):
    """A signature: segments of `width` bytes each, then a sketch of eight bytes at its end."""

    segments: int = 21
    width: int = 3

    @property
    def size(self) -> int:
        return (self.segments * self.width + 8 + 7) // 8 * 8


#: From so many signatures on, segments are wider.
MANY = 1 << 29
WIDE = Layout(75, 4)


class Bounds(NamedTuple):
    """Sizes that decide how runs are worked on. They are sent with the work."""

    #: Runs up to this length are compared at every distance at once, longer ones member by member,
    short: int = 64
    #: and in blocks of so many members.
    block: int = 4096
    #: So many rows are worked on together.
    chunk: int = 1 << 17


#: Of so many texts the shingles are counted, and so many of the most popular are put last. Both decide the time that the exact search takes, never what it finds.
POPULAR_SAMPLE, POPULAR = 20_000, 1 << 16
#: Bits of a set's first parities, and pairs that are compared together. Larger sets have more, see parity_bits().
PARITIES, PAIRS = 512, 1 << 19
#: Parities of so many pairs are held at once.
COMPARED = 1 << 15
#: Counters of a set's shingles, a byte each, that decide of which pairs the sets themselves are fetched.
COUNTERS = 512
#: Shingles that hold a larger share of all are dealt to cells, if that is more than a block; and so many keys (32 MB), and nodes with their digests, at most are sent to all tasks.
CELL_SHARE, SENT_KEYS, SENT_NODES = 1e-5, 1 << 22, 1 << 17

#: A share of the signatures from which a key is hot and is dealt to several tasks; hot keys are looked for among so many signatures.
HOT_SHARE, HOT_SAMPLE = 0.005, 100_000



def seeds(size: int) -> np.ndarray:
    """One for each eight bytes of a signature."""
    return mixed(np.arange(1, size // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int, powers: Powers) -> list[np.ndarray]:
    """Of each row the sorted distinct hashes of its shingles; a row of fewer words, but not none, has one."""
    data = ASCII_LOWER[data]
    s, e, row = word_bounds(data, offsets, WORDS_BY_SPACE)
    rows = len(offsets) - 1
    counts = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    h = word_hashes(data, s, e, powers)
    w = window_hashes(h, shingle)
    at = np.flatnonzero(row[: len(w)] == row[shingle - 1 :]) if len(w) else np.zeros(0, np.int64)
    of, value = [row[at]], [w[at]]
    first = np.cumsum(counts) - counts
    for k in range(1, shingle):
        short = np.flatnonzero(counts == k)
        if len(short):
            of.append(short)
            value.append(window_hashes(h, k)[first[short]])
    of, value = np.concatenate(of), np.concatenate(value)
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    keep = np.ones(len(of), bool)
    keep[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    of, value = of[keep], value[keep]
    return np.split(value, np.searchsorted(of, np.arange(1, rows)))


def signature(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Eight bytes for each seed: a bit is 1 if it is set in over half of the hashes, which are mixed anew for every eight bytes."""
    total = np.zeros(64 * len(own), np.int64)
    for at in range(0, len(hashes), 2040):
        wide = mixed(hashes[at : at + 2040, None] ^ own[None, :])
        bits = np.unpackbits(wide.view(np.uint8), axis=1)
        for a in range(0, len(bits), 255):  # sums of 255 rows fit a byte
            total += np.add.reduce(bits[a : a + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes))


SIGNED = T.StructType().add("digest", "binary").add("n", "integer").add("sig", "binary").add("parity", "binary")


def _sliced(texts: pa.Array, shingle: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(from, to, sets) of slices of the texts."""
    data, offsets = utf8(texts)
    powers = Powers()
    for a, b in slices(offsets):
        yield a, b, shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle, powers)


def _sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    for _, _, sets in _sliced(texts, shingle):
        yield from sets


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.md5(hashes.tobytes()).digest()


def set_key(of: Column) -> Column:
    """The first eight bytes of a digest as a number."""
    return F.conv(F.hex(F.substring(of, 1, 8)), 16, -10).cast("long")


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """set_key() of the digests of sets."""
    return np.frombuffer(b"".join(map(digest, sets)), ">u8")[::2].astype(np.uint64).view(np.int64)


def _signed(shingle: int, layout: Layout):
    own = seeds(layout.size)

    @F.arrow_udf(SIGNED)
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(lambda rows: map(each, rows))(batches)

    def each(texts: pa.Array) -> pa.Array:
        digests, sizes, sigs, odd = [], [], [], []
        for x in _sets(texts, shingle):
            digests.append(digest(x))
            sizes.append(len(x))
            sigs.append(signature(x, own).tobytes())
            odd.append(parities(x.view(np.int64), np.array([len(x)]), parity_bits(len(x))).tobytes())
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(odd, pa.binary())], names=SIGNED.names)

    return signed


def parity_bits(n: int) -> int:
    """The bits of a set of n shingles, a power of two: at least twice n, so that unlike sets differ in enough of them however long they are, and
    eight times n up to 2048, as chance weighs more on smaller sets."""
    return max(PARITIES, 1 << (max(2 * n, min(8 * n, 2048), 1) - 1).bit_length())


def parities(flat: np.ndarray, n: np.ndarray, bits: int = PARITIES) -> np.ndarray:
    """Of each set so many bits, whether an odd number of its shingles falls to each: two sets differ in at least as many shingles as bits."""
    at = np.repeat(np.arange(len(n)) * bits, n) + (flat & (bits - 1))
    odd = np.bincount(at, minlength=len(n) * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(n), bits), axis=1)


class Parities(NamedTuple):
    """Parities of different lengths: eight bytes each, and for each row where they begin and how many they are."""

    flat: np.ndarray
    start: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, column: pa.ChunkedArray) -> Parities:
        words = pa.compute.binary_length(column).to_numpy().astype(np.int64) >> 3
        return cls(np.frombuffer(b"".join(column.to_pylist()), np.uint64), np.cumsum(words) - words, words)

    def folded(self, rows: np.ndarray, words: int) -> np.ndarray:
        """The parities of the rows as if they had been made with so many: bits that then fall together are added."""
        out = np.empty((len(rows), words), np.uint64)
        for own in np.unique(self.words[rows]).tolist():
            at = np.flatnonzero(self.words[rows] == own)
            whole = self.flat[self.start[rows[at], None] + np.arange(own)]
            out[at] = np.bitwise_xor.reduce(whole.reshape(len(at), own // words, words), axis=1)
        return out

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits the pairs differ, with the bits of the one that has fewer."""
        out, fewer = np.zeros(len(x), np.int64), np.minimum(self.words[x], self.words[y])
        for words in np.unique(fewer).tolist():
            at = np.flatnonzero(fewer == words)
            step = max(1, COMPARED * PARITIES // 64 // words)  # the parities of all pairs would take many times their memory
            for a in range(0, len(at), step):
                k = at[a : a + step]
                out[k] = np.bitwise_count(self.folded(x[k], words) ^ self.folded(y[k], words)).sum(axis=1, dtype=np.int64)
        return out


def tally(hashes: np.ndarray) -> np.ndarray:
    """How many of a set's shingles fall to each of COUNTERS counters, which stop at 255: two sets differ in at least as many shingles as their counters."""
    return np.minimum(np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS), 255).astype(np.uint8)


@F.arrow_udf(T.IntegerType())
def _differ(a: pa.Array, b: pa.Array) -> pa.Array:
    """The sum of the differences of the counters of two sets."""
    x, y = (np.frombuffer(b"".join(t.to_pylist()), np.uint8).reshape(-1, COUNTERS).astype(np.int16) for t in (a, b))
    return pa.array(np.abs(x - y).sum(axis=1, dtype=np.int32))


def _flat(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)


def _arrays(sets: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(_flat(sets)))


def _tallies(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([tally(x).tobytes() for x in sets], pa.binary())


def _made(shingle: int, made: Callable[[list[np.ndarray]], pa.Array], name: str):
    """From (node, digest, text) to (node, name): what is made of the sets of the texts that have this digest. A filter by a function's result would have
    Spark call the function twice a row, in two workers a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sliced(batch.column(2), shingle):
                own = [i for i, (x, d) in enumerate(zip(sets, batch.column(1).slice(a, b - a).to_pylist(), strict=True)) if digest(x) == d]
                yield pa.record_batch([batch.column(0).slice(a, b - a).take(pa.array(own, pa.int64())), made([sets[i] for i in own])], names=["node", name])

    return rows


def _each_shingle(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in _sliced(batch.column(0), shingle):
                yield pa.record_batch([pa.array(_flat(sets))], names=["shingle"])

    return rows


BAND = "band long, node long, sketch long"
_BAND = pa.schema([("band", pa.int64()), ("node", pa.int64()), ("sketch", pa.int64())])


def _bands(layout: Layout):
    """From (node, sig) to `width` rows for each segment. band: segment, part, the bytes that must agree, the byte with the wildcard."""
    width = layout.width

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, layout.size)
            parts = sig[:, : width * layout.segments].reshape(n, layout.segments, width).astype(np.int64)
            each = []
            for p in range(width):
                band = np.arange(layout.segments) * width + p
                for k in range(1, width + 1):  # the byte of the part itself comes last
                    band = band << 8 | parts[:, :, (p + k) % width]
                each.append(band)
            band = np.concatenate(each, axis=1)
            rows = band.shape[1]
            sketch = np.ascontiguousarray(sig[:, -8:]).view(np.int64).ravel()
            yield pa.record_batch([pa.array(band.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), rows)), pa.array(np.repeat(sketch, rows))], schema=_BAND)

    return bands


def spanning(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a minimum spanning forest of sketches by their differing bits, none over NEAR: a member is added at a time."""
    n = len(sketch)
    best, parent = np.full(n, 255, np.uint8), np.full(n, -1)
    out, at = [], 0
    best[0] = 254  # one that is in the tree has 255 for good
    open_ = np.ones(n, bool)
    for _ in range(n):
        if parent[at] >= 0:
            out.append((parent[at], at))
        open_[at] = False
        d = np.bitwise_count(sketch ^ sketch[at])
        nearer = open_ & (d < best) & (d <= NEAR)
        best[nearer], parent[nearer] = d[nearer], at
        best[at] = 255
        at = int(best.argmin())
        if best[at] == 255:  # none is near: another tree
            at = int(open_.argmax())
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _forest(run: np.ndarray, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the pairs (x, y) of runs make a minimum spanning forest of each run; two pairs always do."""
    order = np.lexsort((d, run))
    first = np.flatnonzero(np.concatenate([[True], np.diff(run[order]) != 0]))
    keep = np.ones(len(run), bool)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(run)], strict=True):
        if b - a < 3:
            continue
        parent: dict[int, int] = {}
        for i in order[a:b].tolist():
            u, v = int(x[i]), int(y[i])
            while (p := parent.get(u, u)) != u:
                u = p
            while (p := parent.get(v, v)) != v:
                v = p
            if u == v:
                keep[i] = False
            else:
                parent[u] = v
    return keep


def _from_bit(sketch: np.ndarray, bit: int) -> np.ndarray:
    """Sketches read from another bit on."""
    return sketch << np.uint64(bit) | sketch >> np.uint64(64 - bit) if bit else sketch


def linked(band: np.ndarray, node: np.ndarray, sketch: np.ndarray, width: int = 3, bounds: Bounds = Bounds()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (node, node, differing bits of the sketches) among rows of whole keys, or of blocks of a key."""
    key, other = band >> 8, band & 255
    whole = (band >> 8 * width) % width == 0  # pairs that agree in all bytes are taken once, in the first part
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for bit in range(8):
        variant = key << 8 | other & ~(1 << bit)
        order = np.argsort(variant, kind="stable")
        v = variant[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        size = np.diff(np.concatenate([first, [len(v)]]))
        run = np.repeat(np.arange(len(first)), size)
        wanted = lambda x, y: (other[x] != other[y]) | (whole[x] & (bit == 0))  # noqa: E731, B023
        short = size[run] <= bounds.short
        runs, xs, ys = [], [], []
        for lag in range(1, int(size[size <= bounds.short].max(initial=1))):
            i = np.flatnonzero(short[:-lag] & (v[:-lag] == v[lag:]))
            x, y = order[i], order[i + lag]
            near = (np.bitwise_count(sketch[x] ^ sketch[y]) <= NEAR) & (node[x] != node[y])
            runs.append(run[i[near]])
            xs.append(x[near])
            ys.append(y[near])
        if runs:
            r, x, y = map(np.concatenate, (runs, xs, ys))
            if len(r):
                keep = _forest(r, x, y, np.bitwise_count(sketch[x] ^ sketch[y])) & wanted(x, y)
                a.append(x[keep])
                b.append(y[keep])
        for k in np.flatnonzero(size > bounds.short).tolist():
            members = order[first[k] : first[k] + size[k]]
            cut = len(members) > bounds.block
            if cut:
                members = members[np.argsort(_from_bit(sketch[members], 8 * bit))]
            for at in range(0, len(members), bounds.block):
                block = members[at : at + bounds.block]
                x, y = spanning(sketch[block])
                x, y = block[x], block[y]
                keep = wanted(x, y) | cut
                a.append(x[keep])
                b.append(y[keep])
    a, b = np.concatenate(a), np.concatenate(b)
    d = np.bitwise_count(sketch[a] ^ sketch[b])
    a, b = node[a], node[b]
    keep = a != b
    return np.minimum(a, b)[keep], np.maximum(a, b)[keep], d[keep]


LINK = "a long, b long, d int"
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.int32())])


def _links(layout: Layout, bounds: Bounds):
    return lambda batches: _chunks(batches, layout, bounds)


def _chunks(batches: Iterator[pa.RecordBatch], layout: Layout, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """Candidates of rows that come key by key, in chunks of bounds.chunk rows that end with a key if they can."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def done(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        a, b, d = linked(rows[0], rows[1], rows[2].view(np.uint64), layout.width, bounds)
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(d.astype(np.int32))], schema=_LINK)

    for batch in batches:
        held.append(tuple(c.to_numpy() for c in batch.columns))
        n += batch.num_rows
        if n >= bounds.chunk:
            rows = tuple(map(np.concatenate, zip(*held, strict=True)))
            last = int(np.searchsorted(rows[0] >> 8, rows[0][-1] >> 8, "left"))
            cut = last or n
            yield done(tuple(r[:cut] for r in rows))
            held, n = [tuple(r[cut:] for r in rows)], n - cut
    if n:
        yield done(tuple(map(np.concatenate, zip(*held, strict=True))))


def hot_keys(nodes: DataFrame, total: int, layout: Layout, bounds: Bounds) -> DataFrame:
    """(key, ways) of keys that hold over HOT_SHARE of the signatures, and to how many tasks they are dealt: a few
    thousand rows at most, by a sample of bounded size. Rows of a key in different tasks aren't compared for this segment."""
    share = -(-total // HOT_SAMPLE) or 1
    sample = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).select("node", "sig").mapInArrow(released(_bands(layout)), BAND)
    counts = sample.groupBy(F.shiftright("band", 8).alias("key")).count()
    least = max(2 * bounds.short, HOT_SHARE * total / share)
    return counts.filter(F.col("count") > least).select("key", F.ceil(F.col("count") / least).cast("int").alias("ways"))


def candidates(nodes: DataFrame, layout: Layout = Layout(), bounds: Bounds = Bounds()) -> DataFrame:
    """(a, b, d): candidate links of nodes (node, sig), each once, with the differing bits of their sketches."""
    hot = stored(hot_keys(nodes, nodes.count(), layout, bounds), "hot-keys")
    rows = nodes.select("node", "sig").mapInArrow(released(_bands(layout)), BAND).withColumn("key", F.shiftright("band", 8))
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn("at", F.xxhash64("node", "key"))
    rows = rows.select("band", "node", "sketch", "key", "at", F.pmod("at", F.coalesce("ways", F.lit(1))).cast("int").alias("way"))
    dealt = rows.repartition("key", "way").sortWithinPartitions("key", "at").select("band", "node", "sketch")
    return dealt.mapInArrow(released(_links(layout, bounds)), LINK).groupBy("a", "b").agg(F.min("d").alias("d"))


def _of_texts(ids: DataFrame, pairs: DataFrame, nodes: DataFrame, shingle: int, made: Callable[[list[np.ndarray]], pa.Array], name: str, kind: str) -> DataFrame:
    """(node, name) of the nodes of the pairs, what is made of their sets; the texts are shuffled only if the nodes are many."""
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "digest"), "node"), "needed")
    needed = F.broadcast(needed) if needed.count() <= SENT_NODES else needed
    found = ids.join(needed, F.col("id") == F.col("node")).select("node", "digest", "text").mapInArrow(released(_made(shingle, made, name)), f"node long, {name} {kind}")
    return stored(found.groupBy("node").agg(F.first(name).alias(name)), name)


def _sets_of(ids: DataFrame, pairs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes of the pairs."""
    return _of_texts(ids, pairs, nodes, shingle, _arrays, "shingles", "array<long>")


def possible(ids: DataFrame, pairs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that the counters of their sets don't show to be less similar. Parities can't tell long sets apart; and sets, which have
    eight bytes a shingle, go through two shuffles for each pair that is left."""
    of = _of_texts(ids, pairs, nodes, shingle, _tallies, "tally", "binary").join(nodes.select("node", "n"), "node")
    a, b = (of.select(F.col("node").alias(k), F.col("tally").alias(f"t{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    most = (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-6
    return pairs.join(a, "a").join(b, "b").filter(_differ("ta", "tb") <= most).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose sets of shingles are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y")), "b")
    shared = F.size(F.array_intersect("_x", "_y"))
    return both.filter(shared >= similarity * (F.size("_x") + F.size("_y") - shared)).select("a", "b")


class Order(NamedTuple):
    """One order of all shingles: those not listed here by their values, then these by their ranks."""

    shingles: np.ndarray
    ranks: np.ndarray


def popular(ids: DataFrame, total: int, shingle: int) -> Order:
    """The shingles that most texts of a sample share, the most popular last."""
    share = -(-total // POPULAR_SAMPLE) or 1
    sample = ids.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("text").mapInArrow(released(_each_shingle(shingle)), "shingle long")
    top = sample.groupBy("shingle").count().filter("count > 2").orderBy(F.desc("count"), "shingle").limit(POPULAR).toArrow()
    shingles = top.column(0).to_numpy()
    order = np.argsort(shingles)
    return Order(shingles[order], (len(shingles) - order).astype(np.int64))


def _ranks(flat: np.ndarray, order: Order) -> np.ndarray:
    """The rank of each shingle, 0 if it is not listed."""
    if not len(order.shingles):
        return np.zeros(len(flat), np.int64)
    at = np.minimum(np.searchsorted(order.shingles, flat), len(order.shingles) - 1)
    return np.where(order.shingles[at] == flat, order.ranks[at], 0)


def first_shingles(flat: np.ndarray, n: np.ndarray, order: Order, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle): of each set, n of `flat` in turn, the first ones in the order; two sets that are similar enough share one of them."""
    row = np.repeat(np.arange(len(n)), n)
    by = np.lexsort((flat, _ranks(flat, order), row))
    least = np.ceil(similarity * n - 1e-9).astype(np.int64)  # shared with any set that is similar enough
    keep = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) <= np.repeat(n - least, n)
    return row[keep], flat[by][keep]


def _postings(order, shingle: int, similarity: float, shared):
    """From (node, text) to a row (shingle, rank, place, node, set) for each of the first shingles; of these, if `shared` is given, only those in it.
    place: how many of the set's shingles come before it. A slice's sets are made, used and left in the worker: they are never rows."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sliced(batch.column(1), shingle):
                row, first = first_shingles(_flat(sets), np.fromiter(map(len, sets), np.int64, b - a), order.value, similarity)
                place = np.arange(len(row)) - np.searchsorted(row, row)
                if shared is not None:
                    at = np.minimum(np.searchsorted(shared.value, first), len(shared.value) - 1)
                    keep = shared.value[at] == first
                    row, first, place = row[keep], first[keep], place[keep]
                columns = first, _ranks(first, order.value), place, batch.column(0).to_numpy()[a:b][row], set_keys(sets)[row]
                yield pa.record_batch(list(map(pa.array, columns)), names=["shingle", "rank", "place", "node", "set"])

    return postings


#: In a cell a row meets all others, or as one at home the visitors.
BOTH, HOME, VISITS = range(3)


class Cells(NamedTuple):
    """Rows of whole cells, sorted by cell."""

    cell: np.ndarray
    role: np.ndarray
    node: np.ndarray
    root: np.ndarray
    n: np.ndarray
    parity: np.ndarray
    #: How many shingles of the row's set come before the cell's, and all parities, if these are known.
    place: np.ndarray | None = None
    wide: Parities | None = None

    def similar(self, x: np.ndarray, y: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that are of different groups and that neither sizes nor places nor parities show to be less similar.

        Places are judged as if the cell's shingle were the first that the two share. In the cell where it is, this leaves out no similar pair;
        in a later cell it may, but there the pair has been met before."""
        met = (self.role[x] != VISITS) & (self.role[y] != HOME) | (self.role[y] != VISITS) & (self.role[x] != HOME)
        i, j = self.n[x], self.n[y]
        at = np.flatnonzero(met & (self.root[x] != self.root[y]) & (np.minimum(i, j) >= similarity * np.maximum(i, j) - 1e-6))
        x, y = x[at], y[at]
        most = (1 - similarity) / (1 + similarity) * (self.n[x] + self.n[y]) + 1e-6
        if self.place is not None:
            i, j = self.place[x], self.place[y]
            at = np.flatnonzero(i + j + abs((self.n[x] - i) - (self.n[y] - j)) <= most)
            x, y, most = x[at], y[at], most[at]
        differ = np.zeros(len(x), np.int64)
        for a in range(0, len(x), COMPARED):  # the parities of all pairs would take many times their memory
            differ[a : a + COMPARED] = np.bitwise_count(self.parity[x[a : a + COMPARED]] ^ self.parity[y[a : a + COMPARED]]).sum(axis=1, dtype=np.int64)
        at = np.flatnonzero(differ <= most)
        x, y, most = x[at], y[at], most[at]
        if self.wide is not None:
            at = np.flatnonzero(self.wide.differ(x, y) <= most)
            x, y = x[at], y[at]
        return x, y


def apart(rows: Cells, similarity: float, short: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of one cell, of different groups, that may be similar enough: all of them, some twice."""
    first = np.flatnonzero(np.concatenate([[True], rows.cell[1:] != rows.cell[:-1]]))
    size = np.diff(np.concatenate([first, [len(rows.cell)]]))
    is_short = np.repeat(size <= short, size)
    for lag in range(1, int(size[size <= short].max(initial=1))):
        i = np.flatnonzero(is_short[:-lag] & (rows.cell[:-lag] == rows.cell[lag:]))
        x, y = rows.similar(i, i + lag, similarity)
        yield rows.node[x], rows.node[y]
    for k in np.flatnonzero(size > short).tolist():
        of = np.arange(first[k], first[k] + size[k])
        role, (roots, at, count) = rows.role[of], np.unique(rows.root[of], return_inverse=True, return_counts=True)
        left = of[role != VISITS]
        right = of[(role == VISITS) | (role == BOTH) & (at != count.argmax())]  # pairs within the largest group are none
        step = max(1, PAIRS // max(1, len(left)))
        for a in range(0, len(right), step):
            y = right[a : a + step]
            x, y = rows.similar(np.repeat(left, len(y)), np.tile(y, len(left)), similarity)
            yield rows.node[x], rows.node[y]


def _apart(similarity: float, bounds: Bounds):
    """Pairs from rows (shingle, way, part, role, node, root, n, place, parity) that come cell by cell."""

    def pairs(held: list[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).slice(0, rows).combine_chunks()
        column = lambda k: table.column(k).to_numpy()
        changes = np.zeros(rows, bool)
        for k in range(3):
            changes[1:] |= np.diff(column(k)) != 0
        wide = Parities.of(table.column(8))
        parity = wide.folded(np.arange(rows), PARITIES // 64)
        for a, b in apart(Cells(np.cumsum(changes), *map(column, range(3, 7)), parity, column(7), wide), similarity, bounds.short):
            if len(a):
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if n >= bounds.chunk and batch.num_rows:  # up to the end of the cell
                last = [held[-1].column(k)[-1].as_py() for k in range(3)]
                new = np.flatnonzero(np.any([batch.column(k).to_numpy() != last[k] for k in range(3)], axis=0))
                cut = int(new[0]) if len(new) else batch.num_rows
                held.append(batch.slice(0, cut))
                n, batch = n + cut, batch.slice(cut)
                if len(new):
                    yield from pairs(held, n)
                    held, n = [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if n:
            yield from pairs(held, n)

    return chunks


def missed(ids: DataFrame, nodes: DataFrame, roots: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bounds: Bounds = Bounds()) -> DataFrame:
    """(a, b): every pair of nodes (node, digest, n, parity), sets of the texts (id, text), of different groups (node, root; others are alone) that may be
    similar enough, and few others. Sets that share one of their first shingles are compared: all of them with all but the largest group.
    Of shingles that are among the first ones of the very same sets, told by two sums of hashes, the first in the order stands for all.

    A popular shingle's rows have a way and those outside its largest group a part, by hash; the rows of a way are at home in
    a cell for each part, those of a part visit the cell of each way. So each pair meets, and a cell has about a block on either side."""
    spark = ids.sparkSession
    order = spark.sparkContext.broadcast(popular(ids, ids.count(), shingle))
    texts = ids.select(F.col("id").alias("node"), "text")
    posted = lambda shared=None: texts.mapInArrow(released(_postings(order, shingle, similarity, shared)), "shingle long, rank long, place long, node long, set long")
    shared = stored(posted().groupBy("shingle").agg(F.min("set").alias("least"), F.max("set").alias("most")).filter("least < most").select("shingle"), "shared-shingles")
    if 0 < shared.count() <= SENT_KEYS:
        rows = posted(spark.sparkContext.broadcast(np.sort(shared.toArrow().column(0).to_numpy())))
    else:
        rows = posted().join(shared, "shingle")
    owners = nodes.select("node", set_key(F.col("digest")).alias("set")).join(roots, "node", "left").select("node", "set", F.coalesce("root", "node").alias("root"))
    rows = stored(rows.join(owners, ["node", "set"]).select("shingle", "rank", F.col("place").cast("int").alias("place"), "node", "root"), "postings")
    hashed = lambda seed: F.sum(F.shiftright(F.xxhash64("node", F.lit(seed)), 28))
    members = {"n": F.count("*"), "low": F.min("node"), "high": F.max("node"), "h": hashed(1), "g": hashed(2)}
    keys = rows.groupBy("shingle", "rank").agg(F.min("root").alias("least"), F.max("root").alias("most"), *(v.alias(k) for k, v in members.items())).filter("least < most")
    keys = keys.groupBy(*members).agg(F.min(F.struct("rank", "shingle")).alias("first")).select("first.shingle", "n")
    rows = stored(rows.drop("rank").join(keys, "shingle"), "postings")

    block = max(bounds.block, int(CELL_SHARE * rows.count()))
    sizes = rows.filter(F.col("n") > block).groupBy("shingle", "root").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("shingle").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main"))
    parts = lambda n: F.ceil(n / F.lit(block)).cast("int")
    hot = stored(sizes.select("shingle", "main", parts(F.col("n")).alias("ways"), parts(F.col("n") - F.col("most")).alias("parts")), "popular-shingles")
    split = rows.drop("n").join(F.broadcast(hot), "shingle").withColumns({"way": F.pmod(F.xxhash64("node", "shingle"), "ways").cast("int"), "part": F.pmod(F.xxhash64("shingle", "node"), "parts").cast("int")})
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    home = split.select("shingle", "way", each("parts").alias("part"), F.lit(HOME).alias("role"), "node", "root", "place")
    visits = split.filter("root != main").select("shingle", each("ways").alias("way"), "part", F.lit(VISITS).alias("role"), "node", "root", "place")
    cold = rows.filter(F.col("n") <= block).select("shingle", F.lit(0).alias("way"), F.lit(0).alias("part"), F.lit(BOTH).alias("role"), "node", "root", "place")
    cells = cold.unionByName(home).unionByName(visits)

    cells = cells.join(nodes.select("node", "n", "parity"), "node").select("shingle", "way", "part", "role", "node", "root", "n", "place", "parity")
    dealt = cells.repartition("shingle", "way", "part").sortWithinPartitions("shingle", "way", "part")
    return dealt.mapInArrow(released(_apart(similarity, bounds)), "a long, b long").distinct()


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, layout: Layout | None = None, bounds: Bounds = Bounds()) -> DataFrame:
    """(key, component_id) of each document with a key, an integer: the least key reachable over links.

    Two texts link if the Jaccard similarity of their sets of shingles, words of any characters but ASCII white space with
    A-Z lower-cased, is at least `similarity`; no such link is missed and none is below. A text of fewer words is one shingle; texts without words, null ones among them, are
    equal. Rows without a key take no part; repeated rows each get a row; an empty table gives none; a text of any length
    is taken whole; other columns are left out, so names can't clash.
    """
    ids = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
    layout = layout or (WIDE if docs.count() > MANY else Layout())
    rows = stored(ids.select("id", _signed(shingle, layout)(F.col("text")).alias("s")).select("id", "s.digest", "s.n", "s.sig", "s.parity"), "signatures")
    nodes = stored(rows.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("parity").alias("parity")), "nodes")
    many = nodes.filter(F.col("n") >= similarity * (F.col("n") + 1))  # smaller sets are similar to equal ones only
    pairs = stored(candidates(many, layout, bounds), "candidates")
    sets = _sets_of(ids, pairs, many, shingle)
    # the nearest neighbour of each node first; then what is left between different components
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    nearest = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()
    good = stored(_verified(nearest, sets, similarity), "links")
    roots = stored(components(good), "roots")
    x, y = roots.select(F.col("node").alias("a"), F.col("root").alias("x")), roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
    different = pairs.join(x, "a", "left").join(y, "b", "left").filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")
    good = stored(good.unionByName(_verified(different.join(nearest, ["a", "b"], "left_anti"), sets, similarity)), "links")
    roots = stored(components(good), "roots")
    # and all that was never a candidate
    rest = stored(missed(ids, many, roots, shingle, similarity, bounds), "missed")
    rest = stored(possible(ids, rest, many, shingle, similarity), "possible")
    more = stored(_verified(rest, _sets_of(ids, rest, many, shingle), similarity), "links")
    if not more.isEmpty():
        roots = components(good.unionByName(more))
    named = nodes.join(roots, "node", "left").select("digest", "copies", F.coalesce("root", "node").alias("component_id"))
    return joined_hot(rows.select("id", "digest"), named, "digest", "copies").select(F.col("id").alias(key), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs, all columns kept, with the document of the least key of each group of similar documents.

    A document without a key can't be named and stays; of rows that repeat a key and its text one stays; see similar_documents.
    """
    gone = similar_documents(docs, key, text, shingle, similarity).filter(F.col(key) != F.col("component_id")).select(key).distinct()
    kept = docs.join(gone, key, "left_anti").select(docs.columns)
    again = stored(docs.groupBy(key).count().filter(F.col("count") > 1).select(key), "repeated-keys")
    if again.isEmpty():
        return kept
    once = kept.join(again, key, "left_semi").dropDuplicates([key, text])
    return kept.join(again, key, "left_anti").unionByName(once).select(docs.columns)
