"""SimHash fingerprints of documents, and the search for all fingerprints within a Hamming radius.

The words of a text and its pairs of adjacent words are its terms; each term's hash votes on 128 signed bits, weighted by how
often it occurs. For the search the bits are cut into RADIUS + 2 blocks: fingerprints within the radius agree in two blocks at least, so a
table for each two blocks, sorted by them, holds every such pair side by side in one of them. Tables give counts, never pairs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, WORDS_BY_SPACE, Powers, joined_hot, mixed, slices, stored, utf8, window_hashes, word_bounds, word_hashes

BITS = 128
RADIUS = 4
#: A term that occurs n times weighs 1 + ln n, in sixteenths: whole numbers, so that votes don't depend on their order.
WEIGHT_UNIT = 16
#: Terms vote in blocks of so many.
VOTES = 1 << 14
#: Larger runs of a table are dealt anew by two blocks of their other bits.
RUN = 1 << 14
#: Documents are put in order in stretches of about so many bytes, and there are so many stretches at most.
STRETCH_BYTES, STRETCHES = 8 << 20, 50_000


def simhash(texts: pa.Array, powers: Powers) -> np.ndarray:
    """Two unsigned longs for each text; one without words has zeros."""
    data, offsets = utf8(texts)
    out = [np.zeros((0, 2), np.uint64)]
    for i, j in slices(offsets):
        out.append(_simhash(ASCII_LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], powers))
    return np.concatenate(out)


def _simhash(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> np.ndarray:
    starts, ends, row = word_bounds(data, offsets, WORDS_BY_SPACE)
    out = np.zeros((len(offsets) - 1, BITS // 64), np.uint64)
    if not len(starts):
        return out
    words = word_hashes(data, starts, ends, powers)
    inside = row[:-1] == row[1:]
    term, row = np.concatenate([words, window_hashes(words, 2)[inside]]), np.concatenate([row, row[:-1][inside]])
    order = np.lexsort((term, row))
    term, row = term[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])]))
    times = np.diff(np.append(new, len(term)))
    term, row = term[new], row[new]
    weight = np.rint(WEIGHT_UNIT * (1 + np.log(times))).astype(np.float32)
    bits = np.stack([term, mixed(term)], axis=1).view(np.uint8)
    cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])).tolist() + [len(row)]
    for a, b in zip(cuts, cuts[1:]):  # noqa: B905
        votes = np.zeros(BITS, np.int64)
        for i in range(a, b, VOTES):  # whole numbers that float32 holds exactly
            w = weight[i : min(b, i + VOTES)]
            for_ = w @ np.unpackbits(bits[i : i + len(w)], axis=1, bitorder="little").astype(np.float32)
            votes += (2 * for_.astype(np.int64)) - int(w.sum(dtype=np.float64))
        out[row[a]] = np.packbits(votes > 0, bitorder="little").view(np.uint64)
    return out


_PAIR = T.StructType().add("hi", "long").add("lo", "long")


@F.arrow_udf(_PAIR)
def _fingerprints(texts: pa.Array) -> pa.Array:
    found = simhash(texts, Powers()).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(found[:, k], pa.int64()) for k in range(2)], names=["hi", "lo"])


def fingerprint(text: Column) -> Column:
    """A struct (hi, lo) of 64 signed bits each. A null text, and one without words, has zeros; equal texts have equal ones."""
    return _fingerprints(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(fp[k]), 16, "0") for k in ("hi", "lo"))))


def likeness(a: Column, b: Column) -> Column:
    """The share of bits that agree."""
    return 1 - sum(F.bit_count(a[k].bitwiseXOR(b[k])) for k in ("hi", "lo")) / F.lit(float(BITS))


# Documents and their edited texts


def _stretches(keys: DataFrame) -> tuple[list, dict]:
    """Bounds of stretches of the order (key descending, nulls last, then text hash), and for the first key of each
    stretch the number of the stretch before it. Both have a row a stretch; the bounds come from a sample of the keys."""
    total, n = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    wanted = min(STRETCHES, 1 + total // STRETCH_BYTES)
    sample = keys.sample(min(1.0, 50 * wanted / n), seed=1) if n else keys
    rows = sorted((_order(r.id, r.h), r.bytes) for r in sample.collect())  # 50 rows a stretch
    ends = np.cumsum([r[1] + 16 for r in rows])
    at = np.searchsorted(ends, np.arange(1, wanted) * (ends[-1] / wanted)) if len(rows) else []
    bounds = sorted({rows[i][0] for i in at})
    known = keys.sparkSession.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def stretch(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array([bisect_right(known.value, _order(i, h)) for i, h in zip(ids.to_pylist(), hashes.to_pylist(), strict=True)], pa.int32())

    key = F.struct(F.col("id").isNull().alias("none"), F.bitwise_not("id").alias("minus"), "h")
    firsts = keys.select(stretch(F.col("id"), F.col("h")).alias("s"), key.alias("k")).groupBy("s").agg(F.min("k").alias("k")).orderBy("s").collect()
    before = {(r.k.none, 0 if r.k.none else r.k.minus, r.k.h): firsts[i - 1].s for i, r in enumerate(firsts)}
    return bounds, before


def _order(key: int | None, h: int) -> tuple[bool, int, int]:
    return (True, 0, h) if key is None else (False, ~key, h)


_EDITED = T.StructType().add("n_chars", "long").add("edited_sha256", "string").add("own", _PAIR).add("edited", _PAIR).add("next", _PAIR)


def _pairs(found: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(found[:, k].view(np.int64), pa.int64()) for k in range(2)], names=["hi", "lo"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (guest, id, text) in order, each with the text that follows it. A guest is the first of a following stretch,
    there only to be the next one, and ends its stretch; any guests behind the first are equal to it."""
    powers = Powers()
    guest, ids, texts = [], pa.array([], pa.int64()), []
    for batch in batches:
        guest += batch.column(1).to_pylist()
        ids = pa.concat_arrays([ids, batch.column(2)])
        texts += [t or "" for t in batch.column(3).to_pylist()]
        while len(texts) > 1:
            most, n = 0, 0  # about a slice at once; the last text waits for its next one
            while n < len(texts) - 1 and (n == 0 or most < 1 << 20):
                most += 2 * len(texts[n])
                n += 1
            yield from _edited(guest[:n], ids.slice(0, n), texts[: n + 1], powers)
            guest, ids, texts = guest[n:], ids.slice(n), texts[n:]


def _edited(guest: list[int], ids: pa.Array, texts: list[str], powers: Powers) -> Iterator[pa.RecordBatch]:
    kept = [i for i, g in enumerate(guest) if not g]
    if not kept:
        return
    changed = []
    for i in kept:
        half = len(texts[i]) // 2
        changed.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    own = simhash(pa.array(texts, pa.large_string()), powers)
    edited = simhash(pa.array(changed, pa.large_string()), powers)
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    take = np.array(kept)
    columns = [pa.array([len(texts[i]) for i in kept], pa.int64()), pa.array(digests, pa.string()), _pairs(own[take]), _pairs(edited), _pairs(own[take + 1])]
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(take)), *columns], names=["id", *_EDITED.names])


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, own, edited, next) of each row: fingerprints of the text, of its edited text, and of the next document.

    The edited text has its last half (rounded down, in characters) replaced by as many first characters of the next document, or by
    all of a shorter one. Documents follow each other by descending key, which must be an integer; those without a key come last, those
    of one key in the order of their text's hash, repeated rows behind each other; behind the last comes the first. A null text
    is empty. An empty table gives none; other columns are left out, so names can't clash. The texts are shuffled once, in stretches
    of this order; the first document of each is sent to the stretch before it too.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    keys = stored(rows.select("id", "h", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), "keys")
    known = docs.sparkSession.sparkContext.broadcast(_stretches(keys))

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        bounds, before = known.value
        each = [_order(i, h) for i, h in zip(ids.to_pylist(), hashes.to_pylist(), strict=True)]
        return pa.array([[bisect_right(bounds, k), *([before[k]] if k in before else [])] for k in each], pa.list_(pa.int32()))

    dealt = rows.select("id", "text", "h", F.posexplode(places(F.col("id"), F.col("h"))).alias("guest", "stretch"))
    ordered = dealt.repartition("stretch").sortWithinPartitions("stretch", "guest", F.desc_nulls_last("id"), "h").select("stretch", "guest", "id", "text")
    out = T.StructType().add("id", "long")
    found = ordered.mapInArrow(_edits, T.StructType(out.fields + _EDITED.fields))
    return found.select(F.col("id").cast(docs.schema[key].dataType).alias(key), *_EDITED.names)


# Search by permuted block tables


class Blocks:
    """Bits of a mask cut into `number` blocks, tables of two blocks each, and the first table in which a pair meets."""

    def __init__(self, bits: tuple[int, ...], number: int):
        cuts = [len(bits) * k // number for k in range(number + 1)]
        self.blocks = [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.tables = [*combinations(range(number), 2)]
        self.masks = [_mask(b) for b in self.blocks]
        place = {t: i for i, t in enumerate(self.tables)}
        self.first = np.full(1 << number, -1, np.int8)
        for z in range(1 << number):
            equal = [k for k in range(number) if z >> k & 1][:2]
            if len(equal) == 2:
                self.first[z] = place[tuple(equal)]

    def table_mask(self, t: int) -> tuple[int, int]:
        return _mask(tuple(b for k in self.tables[t] for b in self.blocks[k]))

    def rest(self, t: int) -> tuple[int, ...]:
        return tuple(b for k, block in enumerate(self.blocks) if k not in self.tables[t] for b in block)

    def meets_first(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The table that counts a pair, by the bits in which it differs."""
        equal = np.zeros(hi.shape, np.int64)
        for k, (mh, ml) in enumerate(self.masks):
            equal |= (((hi & np.uint64(mh)) | (lo & np.uint64(ml))) == 0).astype(np.int64) << k
        return self.first[equal]


def _mask(bits: tuple[int, ...]) -> tuple[int, int]:
    return sum(1 << b - 64 for b in bits if b >= 64), sum(1 << b for b in bits if b < 64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _run_counts(hi: np.ndarray, lo: np.ndarray, copies: np.ndarray, radius: int, counts) -> np.ndarray:
    """For each member of a run the copies of the others within the radius that this table counts."""
    n, out = len(hi), np.zeros(len(hi), np.int64)
    step = max(1, (1 << 20) // n)
    for a in range(0, n, step):
        dh, dl = hi[a : a + step, None] ^ hi[None, :], lo[a : a + step, None] ^ lo[None, :]
        i, j = np.nonzero(np.bitwise_count(dh) + np.bitwise_count(dl) <= radius)
        i, j = i[i + a != j], j[i + a != j]
        if len(i):
            own = counts(dh[i, j], dl[i, j])
            out[a : a + step] += np.bincount(i[own], copies[j[own]], len(dh)).astype(np.int64)
    return out


_COUNT = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("copies", pa.int64()), ("n", pa.int64()), ("t", pa.int32())])


def _table_counts(radius: int, run: int | None):
    """From rows (t, s, kh, kl, hi, lo, copies) sorted by (t, s, kh, kl): (hi, lo, copies, n, null) with the counts of a fingerprint in a
    run; (hi, lo, copies, null, t) for the members of runs of more than `run`, which are passed on."""
    whole = Blocks(tuple(range(BITS)), radius + 2)
    parts = [Blocks(whole.rest(t), radius + 2) for t in range(len(whole.tables))]

    def counted(t: int, s: int):
        if s < 0:
            return lambda dh, dl: whole.meets_first(dh, dl) == t
        return lambda dh, dl: (whole.meets_first(dh, dl) == t) & (parts[t].meets_first(dh, dl) == s)

    def rows(hi, lo, copies, n, t):
        arrays = [pa.array(x.view(np.int64), pa.int64()) for x in (hi, lo, copies)]
        return pa.record_batch([*arrays, pa.nulls(len(hi), pa.int64()) if n is None else pa.array(n, pa.int64()), pa.nulls(len(hi), pa.int32()) if t is None else pa.array(np.full(len(hi), t), pa.int32())], schema=_COUNT)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 7
        passed = None  # the key of a run that is passed on whole
        last = False
        stream = iter(batches)
        while not last:
            batch = next(stream, None)
            last = batch is None
            cols = held if last else [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(cols[0]):
                continue
            key = cols[:4]
            first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)]))
            sizes = np.diff(np.append(first, len(key[0])))
            whole_runs = len(first) if last else len(first) - 1  # the last run may go on
            hi, lo, copies = cols[4].view(np.uint64), cols[5].view(np.uint64), cols[6]
            for r in np.flatnonzero(sizes[:whole_runs] > 1).tolist() if passed is None else [0, *(1 + np.flatnonzero(sizes[1:whole_runs] > 1)).tolist()][:whole_runs]:
                cut = slice(first[r], first[r] + sizes[r])
                t, s = int(key[0][first[r]]), int(key[1][first[r]])
                at = tuple(int(k[first[r]]) for k in key)
                if at == passed or (run is not None and sizes[r] > run):
                    yield rows(hi[cut], lo[cut], copies[cut], None, t)
                elif sizes[r] > 1:
                    n = _run_counts(hi[cut], lo[cut], copies[cut], radius, counted(t, s))
                    some = n > 0
                    if some.any():
                        yield rows(hi[cut][some], lo[cut][some], copies[cut][some], n[some], None)
            if not last:
                at = tuple(int(k[first[-1]]) for k in key)
                held = [c[first[-1] :] for c in cols]
                passed = passed if at == passed else None
                if run is not None and (sizes[-1] > run or at == passed):
                    yield rows(hi[first[-1] :], lo[first[-1] :], copies[first[-1] :], None, at[0])
                    passed, held = at, [c[:0] for c in held]

    return counts


def _masked(blocks: Blocks, t: Column) -> tuple[Column, Column]:
    masks = [blocks.table_mask(k) for k in range(len(blocks.tables))]
    pick = lambda part: F.col(part).bitwiseAND(F.get(F.array(*(F.lit(_signed(m[part == "lo"])) for m in masks)), t))
    return pick("hi"), pick("lo")


def within(fps: DataFrame, radius: int = RADIUS, run: int = RUN) -> DataFrame:
    """(hi, lo, copies, n): of each distinct fingerprint (hi, lo), borne by `copies` rows, how many rows have another
    fingerprint within the radius. Every such pair is counted once, in the first of the tables where it meets."""
    whole = Blocks(tuple(range(BITS)), radius + 2)
    tables = fps.select("hi", "lo", "copies", F.explode(F.sequence(F.lit(0), F.lit(len(whole.tables) - 1))).alias("t"))
    kh, kl = _masked(whole, F.col("t"))
    order = ("t", "s", "kh", "kl")
    dealt = tables.select("t", F.lit(-1).alias("s"), kh.alias("kh"), kl.alias("kl"), "hi", "lo", "copies").repartition(*order).sortWithinPartitions(*order)
    schema = "hi long, lo long, copies long, n long, t int"
    found = stored(dealt.mapInArrow(_table_counts(radius, run), schema), "near")
    large = found.filter("n is null")
    n_sub = F.explode(F.sequence(F.lit(0), F.lit(len(whole.tables) - 1)))
    again = large.select("hi", "lo", "copies", "t", n_sub.alias("s"))
    keys = [_masked(Blocks(whole.rest(t), radius + 2), F.col("s")) for t in range(len(whole.tables))]
    nested = again.withColumn("kh", kh.bitwiseOR(F.get(F.array(*(k[0] for k in keys)), F.col("t")))).withColumn("kl", kl.bitwiseOR(F.get(F.array(*(k[1] for k in keys)), F.col("t"))))
    deeper = nested.select("t", "s", "kh", "kl", "hi", "lo", "copies").repartition(*order).sortWithinPartitions(*order).mapInArrow(_table_counts(radius, None), schema)
    counts = found.filter("n is not null").unionByName(deeper).groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    return fps.join(counts, ["hi", "lo"], "left").select("hi", "lo", "copies", F.coalesce("n", F.lit(0)).alias("n"))


def near_rows(rows: DataFrame, fp: str = "own", radius: int = RADIUS, run: int = RUN) -> DataFrame:
    """rows with `n_near`, how many other rows have a fingerprint within the radius, equal ones included."""
    known = rows.groupBy(F.col(f"{fp}.hi").alias("hi"), F.col(f"{fp}.lo").alias("lo")).agg(F.count("*").alias("copies"))
    found = within(stored(known, "fingerprints"), radius, run)
    counted = found.select(F.struct("hi", "lo").alias(fp), (F.col("n") + F.col("copies") - 1).alias("n_near"), "copies")
    return joined_hot(rows, counted, fp, "copies")
