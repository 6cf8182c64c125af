"""Repeated passages by FM-indexes.

Every window of WINDOW words has an anchor, the least hash among its runs of GRAM words, so equal windows
have equal anchors. Stretches of windows with one anchor that occurs more than once are dealt by anchor;
each shard builds an FM-index (a wavelet matrix over the Burrows-Wheeler transform) of its distinct stretches
and streams them through it: backward search gives each window's interval, those of two occurrences or more are
reported, and a window goes if the first of its occurrences is an earlier one.

An anchor of more than Bounds.hot_rows stretches, or of more than HOT of all, is hot: its windows are dealt by their DEEP least hashes
instead, which splits its index, and equal stretches are combined where they are before they are dealt. A key that
is still too large is indexed in parts, by the hash of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS_BY_SPACE, Powers, joined_hot, mixed, slices, stored, utf8, window_hashes, word_bounds, word_hashes

WINDOW = 20
GRAM = 6
#: A share of all stretches from which an anchor is hot; there are 1 / HOT hot anchors at most.
HOT = 1e-3
#: Hot anchors are looked for in a sample of about so many stretches.
HOT_SAMPLE = 2_000_000
#: Windows of hot anchors are dealt by so many of their least hashes.
DEEP = 3


class Bounds(NamedTuple):
    """Sizes that decide how work is dealt, never what is found. They are sent with the work."""

    #: An anchor of more stretches is hot, whatever its share. It bounds what a shard holds of other anchors.
    hot_rows: int = 20_000
    #: Equal stretches of hot anchors are combined in a task while so many different ones are held.
    combined: int = 50_000
    #: A shard's index is built when so many words have come together.
    shard_words: int = 250_000
    #: A key of more words is indexed in parts of about so many.
    key_words: int = 4_000_000


def _stretches(data: np.ndarray, offsets: np.ndarray, powers: Powers):
    """Words (starts, ends, row) of a slice, hashes of its runs, and its stretches: anchor, first word, number of windows, whether the anchor is in two places."""
    s, e, row = word_bounds(data, offsets, WORDS_BY_SPACE)
    n = len(s) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return s, e, row, none, none, none, none, none
    grams = least = window_hashes(word_hashes(data, s, e, powers), GRAM).view(np.int64)
    span, width = WINDOW - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    valid = row[:n] == row[WINDOW - 1 :]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(begins)
    total = np.concatenate([[0], np.cumsum(valid)])
    ends = np.concatenate([first[1:], [n]])
    count = total[ends] - total[first]
    inner = count + span - 1  # runs of GRAM words in a stretch
    begin = np.cumsum(inner) - inner
    within = np.arange(int(inner.sum())) + np.repeat(first - begin, inner)
    places = np.add.reduceat(grams[within] == np.repeat(least[first], inner), begin, dtype=np.int64) if len(first) else first
    return s, e, row, grams, least[first], first, count, places > 1


@F.arrow_udf(T.ArrayType(T.LongType()))
def _anchors(texts: pa.Array) -> pa.Array:
    data, offsets = utf8(texts)
    powers, flat, sizes = Powers(), [], []
    for a, b in slices(offsets):
        _, _, row, _, anchor, first, _, again = _stretches(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], powers)
        twice = 1 + again  # a stretch with its anchor in two places counts as two
        flat.append(np.repeat(anchor, twice))
        sizes.append(np.bincount(row[first], weights=twice, minlength=b - a).astype(np.int64) if len(first) else np.zeros(b - a, np.int64))
    ends = np.cumsum(np.concatenate([[0], *sizes]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *flat])))


PAIR = "anchor long, ord long, dk long, hot boolean"
_PAIR = pa.schema([("anchor", pa.int64()), ("ord", pa.int64()), ("dk", pa.int64()), ("hot", pa.bool_())])


def _repeated(hot_rows: int):
    return lambda batches: _twice(batches, hot_rows)


def _twice(batches: Iterator[pa.RecordBatch], hot_rows: int) -> Iterator[pa.RecordBatch]:
    """Of rows (anchor, ord, dk) sorted by anchor, those whose anchor another row has too, and whether it is hot."""
    held, flowing = None, None  # the last anchor's rows; an anchor whose rows are passed on as hot

    def out(rows, keep, hot):
        return pa.record_batch([*(pa.array(r[keep]) for r in rows), pa.array(hot)], schema=_PAIR)

    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if flowing is not None:
            n = int(np.searchsorted(rows[0], flowing, "right"))
            yield out(rows, slice(0, n), np.ones(n, bool))
            rows = [r[n:] for r in rows]
            flowing = flowing if not len(rows[0]) else None
        if not len(rows[0]):
            held = None
            continue
        first = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        size = np.diff(first)
        last = int(first[-1])
        each = np.repeat(size, size)
        yield out([r[:last] for r in rows], each > 1, each[each > 1] > hot_rows)
        held = [r[last:] for r in rows]
        if len(held[0]) > hot_rows:
            flowing = held[0][0]
            yield out(held, slice(None), np.ones(len(held[0]), bool))
            held = None
    if held is not None and len(held[0]) > 1:
        yield out(held, slice(None), np.zeros(len(held[0]), bool))


SEGMENT = T.StructType().add("key", "long").add("ord", "long").add("dk", "long").add("start", "integer").add("n", "integer").add("words", "binary")
_SEGMENT = pa.schema([("key", pa.int64()), ("ord", pa.int64()), ("dk", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])


def _deep(grams: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of stretches, cut where their DEEP least hashes change: key, first word, number of windows."""
    total = np.cumsum(count)
    w = np.arange(int(total[-1])) + np.repeat(first - total + count, count)
    least = np.partition(grams[w[:, None] + np.arange(WINDOW - GRAM + 1)], DEEP - 1, axis=1)[:, :DEEP]
    least.sort(axis=1)
    key = np.zeros(len(w), np.uint64)
    for k in range(DEEP):
        key = mixed(key ^ least[:, k].view(np.uint64))
    cut = np.ones(len(w), bool)
    cut[1:] = (key[1:] != key[:-1]) | (w[1:] != w[:-1] + 1)
    cut[(total - count)] = True
    at = np.flatnonzero(cut)
    return key[at].view(np.int64), w[at], np.diff(np.concatenate([at, [len(w)]]))


def _wanted(listed: pa.Array, rows: np.ndarray, anchor: np.ndarray) -> list[int]:
    """The stretches whose anchor is in their document's list."""
    flat, sizes = listed.flatten().to_numpy(), pa.compute.list_value_length(listed.fill_null([])).to_numpy(zero_copy_only=False)
    wanted = set(zip(np.repeat(np.arange(len(listed)), sizes).tolist(), flat.tolist(), strict=True))
    return [i for i, pair in enumerate(zip(rows.tolist(), anchor.tolist(), strict=True)) if pair in wanted] if wanted else []


def _segments(combined: int):
    return lambda batches: _cut(batches, combined)


def _cut(batches: Iterator[pa.RecordBatch], combined: int) -> Iterator[pa.RecordBatch]:
    """Of documents (ord, dk, text, anchors, hot): the stretches of the listed anchors, words joined by a space; of hot ones each
    once in a task, at its first place, and ranges of words (n, no words) to remove at its others."""
    powers = Powers()
    held: dict[bytes, tuple[int, int, int, int]] = {}  # stretches of hot anchors: place and key

    def flushed() -> pa.RecordBatch:
        places = list(zip(*held.values(), strict=True))
        out = [pa.array(places[3], pa.int64()), *(pa.array(c, t) for c, t in zip(places[:3], (pa.int64(), pa.int64(), pa.int32()), strict=True)), pa.nulls(len(held), pa.int32()), pa.array(list(held), pa.binary())]
        held.clear()
        return pa.record_batch(out, schema=_SEGMENT)

    for batch in batches:
        data, offsets = utf8(batch.column(2))
        ords, dks, listed, hot = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3), batch.column(4)
        for a, b in slices(offsets):
            part = data[offsets[a] : offsets[b]]
            s, e, row, grams, anchor, first, count, _ = _stretches(part, offsets[a : b + 1] - offsets[a], powers)
            raw, begin, rows = part.tobytes(), np.searchsorted(row, np.arange(b - a)), row[first]

            def words(x, n, s=s, e=e, raw=raw):
                return [b" ".join(raw[i:j].split()) for i, j in zip(s[x].tolist(), e[x + n + WINDOW - 2].tolist(), strict=True)]

            at = _wanted(listed.slice(a, b - a), rows, anchor)
            if at:
                x, r = first[at], rows[at]
                yield pa.record_batch([pa.array(anchor[at]), pa.array(ords[a:b][r]), pa.array(dks[a:b][r]), pa.array((x - begin[r]).astype(np.int32)), pa.nulls(len(at), pa.int32()), pa.array(words(x, count[at]), pa.binary())], schema=_SEGMENT)
            at = _wanted(hot.slice(a, b - a), rows, anchor)
            if at:
                key, x, n = _deep(grams, first[at], count[at])
                r, gone = row[x], []
                for place, w in zip(zip(ords[a:b][r].tolist(), dks[a:b][r].tolist(), (x - begin[r]).tolist(), key.tolist(), strict=True), words(x, n), strict=True):
                    before = held.setdefault(w, place)
                    if before[:3] != place[:3]:
                        later = max(before, place)
                        held[w] = min(before, place)
                        gone.append({"key": later[1], "ord": later[0], "dk": later[1], "start": later[2], "n": w.count(b" ") + 1})
                if gone:
                    yield pa.RecordBatch.from_pylist(gone, schema=_SEGMENT)
                if len(held) > combined:
                    yield flushed()
    if held:
        yield flushed()


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit vector a level, packed in words with the counts before them."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        n = len(seq)
        for level in range(self.levels - 1, -1, -1):
            bits = (seq >> level) & 1 > 0
            packed = np.packbits(np.concatenate([bits, np.zeros(-n % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            self.zeros.append(n - int(bits.sum()))
            seq = np.concatenate([seq[~bits], seq[bits]])
        self.start = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            block = at >> 6
            ones = self.before[k][block] + np.bitwise_count(self.words[k][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> (self.levels - 1 - k)) & 1 > 0, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.start[symbol]


class FMIndex:
    """Of a sequence of symbols, 0 being a separator. Suffixes are ordered by their first `depth` symbols at least, which is right for patterns that are shorter."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int = 32):
        rank, k = text.astype(np.int64), 1
        while True:
            following = np.zeros_like(rank)
            following[:-k or None] = rank[k:] + 1 if k < len(rank) else 0
            pair = rank * (int(rank.max()) + 2) + following
            self.suffixes = np.argsort(pair)
            ordered = pair[self.suffixes]
            rank = np.empty_like(rank)
            rank[self.suffixes] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            k *= 2
            if k >= depth or k >= len(rank) or rank[self.suffixes[-1]] == len(rank) - 1:
                break
        self.matrix = WaveletMatrix(text[self.suffixes - 1], symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])

    def repeats(self, text: np.ndarray, at: np.ndarray, length: int):
        """Which of the patterns text[at:at + length] occur twice at least, and their intervals of suffixes.

        One step to the left a round for all patterns; those whose matching statistic ends below `length`
        (one occurrence is left, their own) leave the search.
        """
        alive = np.arange(len(at))
        symbol = text[at + length - 1]
        low, high = self.first[symbol], self.first[symbol + 1]
        for step in range(length - 2, -1, -1):
            more = high - low > 1
            if not more.all():
                alive, low, high = alive[more], low[more], high[more]
            symbol = text[at[alive] + step]
            both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = self.first[symbol] + both[: len(low)], self.first[symbol] + both[len(low) :]
        more = high - low > 1
        return alive[more], low[more], high[more]


def _later(text: np.ndarray, symbols: int, at: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows text[at:at + window] have an equal one at a smaller place, by backward search for all of them. at is sorted."""
    index = FMIndex(text, symbols)
    alive, low, high = index.repeats(text, at, window)
    if not len(alive):
        return np.zeros(0, np.int64)
    bounds, of = np.unique(low, return_inverse=True)
    upper = np.zeros(len(bounds), np.int64)
    upper[of] = high
    ordered = np.concatenate([place[index.suffixes], [0]])
    earliest = np.minimum.reduceat(ordered, np.column_stack([bounds, upper]).ravel())[::2]
    return np.sort(at[alive[earliest[of] < place[at[alive]]]])


def _joined_text(segments: list[tuple[int, int, int, bytes]]):
    """Segments by place as one sequence of symbols, 0 behind each: their order, symbols, first places, the segment of each symbol and its place."""
    chosen = sorted(range(len(segments)), key=lambda i: segments[i][:3])
    codes: dict[bytes, int] = {}
    text, ends = [], []
    for i in chosen:
        text += [codes.setdefault(w, len(codes) + 1) for w in segments[i][3].split(b" ")]
        text.append(0)
        ends.append(len(text))
    text, ends = np.array(text, np.int64), np.array(ends, np.int64)
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    sizes = ends - begins
    seg = np.repeat(np.arange(len(chosen)), sizes)
    docs: dict[tuple[int, int], int] = {}
    doc = np.array([docs.setdefault(segments[i][:2], len(docs)) for i in chosen], np.int64)
    offset = np.arange(len(text)) - begins[seg]
    place = (doc << 32)[seg] + np.array([segments[i][2] for i in chosen], np.int64)[seg] + offset  # order of all places
    return chosen, text, len(codes) + 1, seg, sizes, offset, place


def earlier_windows(segments: list[tuple[int, int, int, bytes]], window: int = WINDOW, most: int | None = None) -> list[tuple[int, int, int]]:
    """Of segments (ord, dk, start, words): (segment, offset, words) of what is covered by windows that also start earlier.

    Order is by ord, dk and start. Segments must hold all occurrences of their windows, each sequence of words once, at its first place.
    With `most`, no index has more words: each window goes to a part by its hash, once, and every part has an index of its own.
    """
    if not segments:
        return []
    chosen, text, symbols, seg, sizes, offset, place = _joined_text(segments)
    at = np.flatnonzero(offset + window < sizes[seg])
    if most is None or len(text) <= most:
        gone = _later(text, symbols, at, place, window)
    else:
        hashes = window_hashes(mixed(text.astype(np.uint64)), window)[at]
        parts = len(at) * (window + 1) // most + 1
        part = (hashes >> np.uint64(11)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        found = [np.zeros(0, np.int64)]
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            own = at[order[a:b]]
            if len(own) < 2:
                continue
            whole = np.concatenate([text[own[:, None] + np.arange(window)], np.zeros((len(own), 1), np.int64)], axis=1)
            words, codes = np.unique(whole, return_inverse=True)  # 0 stays the separator
            places = np.repeat(place[own], window + 1)
            later = _later(codes.ravel(), len(words), np.arange(len(own)) * (window + 1), places, window)
            found.append(own[later // (window + 1)])
        gone = np.sort(np.concatenate(found))
    if not len(gone):
        return []
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(gone) > 1) | (np.diff(seg[gone]) > 0)]))
    last = np.concatenate([cuts[1:], [len(gone)]]) - 1
    return [(chosen[seg[gone[a]]], int(offset[gone[a]]), int(gone[b] - gone[a]) + window) for a, b in zip(cuts.tolist(), last.tolist(), strict=True)]


_RANGE = pa.schema([("ord", pa.int64()), ("dk", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
RANGE = "ord long, dk long, start int, n int"


def _indexed(bounds: Bounds):
    """A function from rows of _segments sorted by key to ranges of words to remove: keys are kept whole, shards have bounds.shard_words words or more.

    Of equal stretches the first one is indexed; all windows of the others go.
    """

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _shards(batches, bounds)

    return indexed


def _shards(batches: Iterator[pa.RecordBatch], bounds: Bounds) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, tuple[int, int, int]] = {}
    gone: list[tuple[int, int, int, int]] = []
    words, last = 0, None

    def done() -> pa.RecordBatch:
        segments = [(*p, w) for w, p in held.items()]
        found = earlier_windows(segments, most=bounds.key_words)
        rows = gone + [(segments[i][0], segments[i][1], segments[i][2] + a, n) for i, a, n in found]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RANGE, strict=True)] if rows else [pa.array([], f.type) for f in _RANGE], schema=_RANGE)

    for batch in batches:
        for key, o, d, s, n, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if w is None:
                gone.append((o, d, s, n))
                continue
            if key != last and words >= bounds.shard_words:
                yield done()
                held, gone, words = {}, [], 0
            last, place = key, (o, d, s)
            before = held.setdefault(w, place)
            if before is place:
                words += w.count(b" ") + 1
            elif before != place:
                held[w] = min(before, place)
                gone.append((*max(before, place), w.count(b" ") + 1))
    if held or gone:
        yield done()


KEPT = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept", "string")


@F.arrow_udf(KEPT)
def _kept(texts: pa.Array, later_copy: pa.Array, ranges: pa.Array) -> pa.Array:
    words_, removed, kept = [], [], []
    for t, copy, cut in zip(texts, later_copy, ranges, strict=True):
        raw = (t.as_py() or "").encode()
        words = raw.split()
        n = len(words)
        if copy.as_py() and n >= WINDOW:
            keep = []
        elif cut.is_valid and len(cut):
            gone = np.zeros(n + 1, np.int64)
            for r in cut.as_py():
                gone[r["start"]] += 1
                gone[r["start"] + r["n"]] -= 1
            stays = np.cumsum(gone)[:-1] == 0
            keep = [words[i] for i in np.flatnonzero(stays).tolist()]
        else:
            keep = words
        words_.append(n)
        removed.append(n - len(keep))
        kept.append(b" ".join(keep).decode())
    return pa.StructArray.from_arrays([pa.array(words_, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=KEPT.names)


def hot_anchors(anchors: DataFrame) -> DataFrame:
    """(anchor) of those that hold more than HOT of the rows (dk, anchors): 1 / HOT rows at most, by a sample of bounded size.

    It decides how stretches are dealt; none is left out."""
    total = anchors.agg(F.sum(F.size("anchors"))).first()[0] or 0
    share = -(-total // HOT_SAMPLE) or 1
    sample = anchors.filter(F.pmod("dk", F.lit(share)) == 0).select(F.explode("anchors").alias("anchor"))
    return sample.groupBy("anchor").count().filter(F.col("count") > max(100.0, HOT * total / share)).select("anchor")


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", bounds: Bounds = Bounds()) -> DataFrame:
    """(key, n_words, n_removed, kept) of each document: kept are the words left, joined by one space.

    A word goes if it is covered by a window of WINDOW words whose sequence also starts earlier: in a
    document of a smaller key, an integer, or before it in the same one. Null keys come first; documents that share a key
    but not their text are ordered by a hash, rows that repeat a document are one document. A null or short
    text keeps its words; texts of any length are read whole; an empty table gives no rows; other columns are left out, so names
    can't clash. Whole copies of a document are told by the digest of their text and go without the index.
    """
    own = ["ord", "dk"]  # a document; the hash tells those apart that share a key
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("dk"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("ord"))
    first_pass = stored(docs.select(*own, F.md5(F.coalesce("text", F.lit(""))).alias("digest"), _anchors(F.col("text")).alias("anchors")).filter(F.size("anchors") > 0), "anchors")
    # exact copies: all but the first one go whole
    one = F.struct(*own)
    first = first_pass.groupBy("digest").agg(F.min(one).alias("first"), F.max(one).alias("last"), F.count("*").alias("copies")).filter("first != last").drop("last")
    copies = joined_hot(first_pass.select(*own, "digest"), first, "digest", "copies").filter(one != F.col("first")).select(*own).distinct().withColumn("copy", F.lit(True))
    # anchors that occur twice
    hot = stored(hot_anchors(first_pass), "hot")
    every = first_pass.select(F.explode("anchors").alias("anchor"), *own)
    cold = every.join(F.broadcast(hot), "anchor", "left_anti")
    twice = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeated(bounds.hot_rows), PAIR)
    twice = twice.unionByName(every.join(F.broadcast(hot), "anchor", "left_semi").withColumn("hot", F.lit(True)))
    lists = [F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot")]
    listed = twice.groupBy(*own).agg(*lists)
    marks = stored(listed.join(copies, own, "full").select(*own, "anchors", "hot", F.coalesce("copy", F.lit(False)).alias("copy")), "marks")
    # stretches of the documents that have such anchors, dealt by anchor
    joined = docs.join(marks, own, "left")
    stretches = joined.filter(~F.col("copy") & F.col("anchors").isNotNull()).select(*own, "text", "anchors", "hot").mapInArrow(_segments(bounds.combined), SEGMENT)
    ranges = stretches.repartition("key").sortWithinPartitions("key").mapInArrow(_indexed(bounds), RANGE)
    cut = ranges.groupBy(*own).agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    out = joined.join(cut, own, "left").select("id", _kept(F.col("text"), F.coalesce("copy", F.lit(False)), F.col("ranges")).alias("k"))
    return out.select(F.col("id").alias(key), "k.n_words", "k.n_removed", "k.kept")
