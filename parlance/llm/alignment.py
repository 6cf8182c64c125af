"""Alignment of the tokens that two tokenizers give the same texts.

Both tokenise a text fully. Offsets where the tokens before a space-marked token end in both tokenizers are anchors: they
split the text into windows, each known by its two tuples of token ids. A window is aligned once, then remembered by these
tuples, so that the work follows the different windows, not the text.

How often two ids are linked is counted over the corpus. Tokens are linked where they end together on the same bytes, so
the bytes of one are the end of the other's: a vocabulary has no more such pairs than its tokens have bytes, and the table
of counts is bounded by the two vocabularies (half a million pairs for those at hand), however large the corpus is.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: The vocabulary files on the driver's machine, parameters of all functions. They are sent to the workers.
BYTES_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Longer texts are tokenised in parts of about so many characters, cut where neither tokenizer can join them.
PART_CHARS = 1 << 18
#: Windows of more tokens are aligned each time; so many shorter ones are remembered by a worker, then it starts anew.
KEPT_TOKENS, KEPT_WINDOWS = 64, 250_000
#: New windows of texts of about so many characters are aligned together.
TOGETHER_CHARS = 1 << 16
#: The fast engine of the byte tokenizer splits by recursion, which long white space overflows; such parts go to the plain one.
_LONG_SPACE = re.compile(r"\s{500}")
# Fixed value: the word pattern of this family of byte-level tokenizers.
_BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


@cache
def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, as characters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(printable))
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _table(tokens: dict[int, bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """By id: the bytes, their number, and whether they begin with a space."""
    listed = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    return listed, np.array([*map(len, listed)], np.int64), np.array([t[:1] == b" " for t in listed])


class Tokenizers:
    """Both tokenizers in a worker."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(bytes_path, encoding="utf-8") as f:
            described = json.load(f)
        vocabulary, merges = described["model"]["vocab"], described["model"]["merges"]
        special = {t["content"] for t in described["added_tokens"]}
        byte = _byte_of_char()
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items() if t not in special}
        self.plain = Tokenizer.from_file(bytes_path)
        self.plain.encode_special_tokens = True
        joined = ("".join(m.split(" ") if isinstance(m, str) else m) for m in merges)
        # ids in the order of the merges, and nothing but merges: then ranks alone give the same tokens, five times as fast
        ranked = described["pre_tokenizer"] == _BYTE_LEVEL and described["normalizer"] is None and [*map(vocabulary.get, joined)] == [*range(256, 256 + len(merges))]
        self.fast = tiktoken.Encoding("bytes", pat_str=_BYTE_WORDS, mergeable_ranks=ranks, special_tokens={}) if ranked else None
        self.a, self.len_a, self.mark_a = _table({i: t for t, i in ranks.items()})

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        ids = range(self.pieces.get_piece_size())
        written = [self.pieces.id_to_piece(i) for i in ids]
        self.b, self.len_b, self.mark_b = _table({i: bytes([int(w[3:5], 16)]) if self.pieces.is_byte(i) else w.replace("▁", " ").encode() for i, w in zip(ids, written, strict=True)})
        #: How an id is written: what stands behind it tells whether it is the last of its side in a group.
        self.written = [f"{i}{mark}".encode() for table, last in ((self.a, "|"), (self.b, ";")) for i in range(len(table)) for mark in (",", last)]
        self.kept: dict[tuple[bytes, bytes], tuple | bool] = {}

    def ids_a(self, text: str) -> np.ndarray:
        if self.fast is None or _LONG_SPACE.search(text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.int32)
        return np.array(self.fast.encode_ordinary(text), np.int32)

    def ids_b(self, text: str) -> np.ndarray:
        """The piece tokenizer puts a space before the text by itself."""
        return np.array(self.pieces.encode(text), np.int32)

    def _learn(self, keys: list[tuple[bytes, bytes]]) -> None:
        """Aligns new windows together and remembers of each its bytes, groups as text, links and group sizes; False if the tokens' bytes differ."""
        sizes = [np.fromiter((len(k[side]) >> 2 for k in keys), np.int64, len(keys)) for side in range(2)]
        a, b = (np.frombuffer(b"".join([k[side] for k in keys]), np.int32) for side in range(2))
        last_a, last_b = np.cumsum(sizes[0]), np.cumsum(sizes[1])
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        raw = [b"".join(map(table.__getitem__, ids.tolist())) for table, ids in ((self.a, a), (self.b, b))]
        if raw[0] != raw[1] or not np.array_equal(ends_a[last_a - 1], ends_b[last_b - 1]):
            if len(keys) == 1:
                self.kept[keys[0]] = False
                return
            for part in (keys[: len(keys) // 2], keys[len(keys) // 2 :]):  # find the windows that differ
                self._learn(part)
            return
        j = np.searchsorted(ends_b, ends_a)  # both end together, so this is never behind the last one
        last = ends_b[j] == ends_a
        i, j = np.flatnonzero(last), j[last]
        shared, last_of_b = ends_a[i], np.zeros(len(b), bool)
        last_of_b[j] = True
        links = a[i].astype(np.int64) * len(self.b) + b[j]
        after_i, after_j = i + 1, j + 1
        written = np.empty(len(a) + len(b), np.int64)  # each id behind the ids before it in its group and all of earlier groups
        written[np.arange(len(a)) + np.concatenate([[0], after_j])[np.cumsum(last) - last]] = 2 * a + last
        written[np.arange(len(b)) + after_i[np.cumsum(last_of_b) - last_of_b]] = 2 * (len(self.a) + b) + last_of_b
        text = [*map(self.written.__getitem__, written.tolist())]
        groups = np.stack([np.diff(after_i, prepend=0), np.diff(after_j, prepend=0)], axis=1).astype(np.int32).tobytes()
        links, ends = links.tobytes(), ends_a[last_a - 1]
        at = 8 * np.searchsorted(shared, ends, "right")
        x = y = z = 0
        for key, x1, y1, z1 in zip(keys, (last_a + last_b).tolist(), ends.tolist(), at.tolist(), strict=True):
            self.kept[key] = raw[0][y:y1], b"".join(text[x:x1])[:-1], links[z:z1], groups[z:z1]
            x, y, z = x1, y1, z1

    def windows(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[tuple[bytes, bytes]], list[int]]:
        """Ids of both tokenizers for parts that begin with a space, their windows by their ids, and each part's first window."""
        each_a, each_b = [*map(self.ids_a, parts)], [self.ids_b(p[1:]) for p in parts]
        sides = []
        for each, length, mark in ((each_a, self.len_a, self.mark_a), (each_b, self.len_b, self.mark_b)):
            ids, n = np.concatenate(each), np.array([*map(len, each)])
            first = np.cumsum(n) - n
            starts = np.cumsum(length[ids]) - length[ids]
            starts += np.repeat((np.arange(len(parts)) << 40) - starts[first], n)  # bytes of the own part
            marked = mark[ids]
            marked[first] = True
            at = np.flatnonzero(marked)
            sides.append((ids, first, at, starts[at]))
        (a, first, at_a, starts_a), (b, _, at_b, starts_b) = sides
        k = np.minimum(np.searchsorted(starts_b, starts_a), len(starts_b) - 1)
        shared = starts_b[k] == starts_a
        cuts_a, cuts_b = at_a[shared], at_b[k[shared]]
        begins = np.searchsorted(cuts_a, first).tolist()
        raw_a, raw_b = a.tobytes(), b.tobytes()
        x, y = (4 * np.append(cuts_a, len(a))).tolist(), (4 * np.append(cuts_b, len(b))).tolist()
        return each_a, each_b, [(raw_a[a0:a1], raw_b[b0:b1]) for a0, a1, b0, b1 in zip(x, x[1:], y, y[1:])], [*begins, len(cuts_a)]  # noqa: B905

    def align_all(self, texts: list[str | None], detail: bool) -> list[Alignment | None]:
        """The alignment of each text; None where it has no tokens."""
        out = [Alignment() if t else None for t in texts]
        held, chars = [], 0
        for i, text in enumerate(texts):
            for part in _parts(" " + text) if text else ():
                held.append((i, part))
                chars += len(part)
                if chars >= TOGETHER_CHARS:
                    self._align(held, out, detail)
                    held, chars = [], 0
        self._align(held, out, detail)
        return out

    def _align(self, parts: list[tuple[int, str]], out: list[Alignment | None], detail: bool) -> None:
        parts = [(i, part) for i, part in parts if out[i]]
        if not parts:
            return
        a, b, keys, begins = self.windows([part for _, part in parts])
        if len(self.kept) > KEPT_WINDOWS:
            self.kept.clear()
        known = [*map(self.kept.get, keys)]
        missing = [n for n, w in enumerate(known) if w is None]
        if missing:
            new = [*dict.fromkeys([keys[n] for n in missing])]
            self._learn(new)
            for n in missing:
                known[n] = self.kept[keys[n]]
            longest = 4 * KEPT_TOKENS
            for k in new:
                if len(k[0]) > longest or len(k[1]) > longest:
                    del self.kept[k]
        for (i, part), own_a, own_b, x, y in zip(parts, a, b, begins, begins[1:]):  # noqa: B905
            if out[i]:
                own = known[x:y]
                if False in own or b"".join([w[0] for w in own]) != part.encode():
                    out[i] = None
                else:
                    out[i].add(own_a, own_b, own, detail)


class Alignment:
    """What is found of a text, part by part."""

    def __init__(self):
        self.digest, self.links, self.n_a, self.n_b, self.detail = hashlib.sha256(), [], 0, 0, []

    def add(self, a: np.ndarray, b: np.ndarray, windows: list[tuple], detail: bool) -> None:
        if self.links:
            self.digest.update(b";")
        self.digest.update(b";".join([w[1] for w in windows]))
        self.links.append(b"".join([w[2] for w in windows]))
        self.n_a, self.n_b = self.n_a + len(a), self.n_b + len(b)
        if detail:
            self.detail.append((a.tobytes(), b.tobytes(), b"".join([w[3] for w in windows])))


def _parts(text: str) -> Iterator[str]:
    """Parts of a text that begin at a single space between two other characters: no token of either kind spans it."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = text.find(" ", at + PART_CHARS)
        while cut >= 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@cache
def _tokenizers(bytes_name: str, pieces_name: str) -> Tokenizers:
    return Tokenizers(SparkFiles.get(bytes_name), SparkFiles.get(pieces_name))


def _lists(parts: list[bytes], kind: pa.DataType) -> pa.Array:
    width = kind.bit_width // 8
    offsets = np.concatenate([[0], np.cumsum([len(p) // width for p in parts])])
    raw = b"".join(parts)
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.Array.from_buffers(kind, len(raw) // width, [None, pa.py_buffer(raw)])).cast(pa.list_(kind))


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", bytes_path: str = BYTES_MODEL, pieces_path: str = PIECES_MODEL, detail: bool = False) -> DataFrame:
    """(key, n_a, n_b, groups_sha256, links) of each row; a link is the first tokenizer's id times the size of the second's
    vocabulary, plus the second's id. With `detail` also a_ids, b_ids and group_sizes, numbers of a and b tokens in turn.

    Null and empty texts, and those that one of the tokenizers doesn't spell exactly, have no tokens: zeros, an empty digest and
    no links. Each row is judged by itself: repeated rows and keys, and null keys, each have theirs; an empty table has none. Other
    columns are left out, so names can't clash. Texts are tokenised whole; long ones in parts that give the same tokens.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(bytes_path)
    spark.sparkContext.addFile(pieces_path)
    names = os.path.basename(bytes_path), os.path.basename(pieces_path)
    ids = T.ArrayType(T.IntegerType())
    out = T.StructType([docs.schema[key]]).add("n_a", "long").add("n_b", "long").add("groups_sha256", "string").add("links", T.ArrayType(T.LongType()))
    if detail:
        out = out.add("a_ids", ids).add("b_ids", ids).add("group_sizes", ids)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collects = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and the collector would walk through all windows again and again
        try:
            yield from aligned_batches(rows)
        finally:
            if collects:
                gc.enable()

    def aligned_batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(*names)
        for batch in rows:
            size = np.cumsum(pa.compute.binary_length(batch.column(1).fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)) // (1 << 20)
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                found = both.align_all(batch.column(1).slice(i, j - i).to_pylist(), detail)
                digests = [f.digest.hexdigest() if f else "" for f in found]
                columns = [batch.column(0).slice(i, j - i), *(pa.array([getattr(f, n) if f else 0 for f in found], pa.int64()) for n in ("n_a", "n_b")), pa.array(digests, pa.string())]
                columns.append(_lists([b"".join(f.links) if f else b"" for f in found], pa.int64()))
                if detail:
                    columns += [_lists([b"".join([d[k] for d in f.detail]) if f else b"" for f in found], pa.int32()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return docs.select(key, text).mapInArrow(batches, out)


def link_counts(found: DataFrame) -> DataFrame:
    """(link, n): how many links of the corpus are of each pair of ids. Counted in every task before the shuffle."""
    return found.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))


def agreement(found: DataFrame, pieces_path: str = PIECES_MODEL) -> Column:
    """A column (n_best, count_sum) for the links of the rows of `found`, a stored table of aligned().

    The counts come to the driver and go to all workers: a row for each pair of ids that ends on the same bytes, which the two
    vocabularies bound (see above), 17 bytes each.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=pieces_path).get_piece_size()
    counts = link_counts(found).toArrow()
    codes, n = (counts.column(k).to_numpy() for k in range(2))
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    most = np.zeros(n_b, np.int64)
    np.maximum.at(most, codes % n_b, n)
    table = found.sparkSession.sparkContext.broadcast((codes, n, n == most[codes % n_b]))
    kind = pa.struct([("n_best", pa.int64()), ("count_sum", pa.int64())])

    @F.arrow_udf(T.StructType().add("n_best", "long").add("count_sum", "long"))
    def summed(links: pa.Array) -> pa.Array:
        known, number, best = table.value
        ends = np.cumsum(pa.compute.list_value_length(links).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        place = np.searchsorted(known, links.flatten().to_numpy(zero_copy_only=False))
        sums = [np.diff(np.concatenate([[0], np.cumsum(v[place])])[np.concatenate([[0], ends])]) for v in (best.astype(np.int64), number)]
        return pa.StructArray.from_arrays([pa.array(s, pa.int64()) for s in sums], fields=[*kind])

    return summed(F.col("links"))


def agreements(docs: DataFrame, key: str = "doc_id", text: str = "text", bytes_path: str = BYTES_MODEL, pieces_path: str = PIECES_MODEL) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row, with aligned()'s rules.

    No token is empty, so each group ends in one link. Texts are tokenised once: what is found is stored, then counted and summed."""
    found = stored(aligned(docs, key, text, bytes_path, pieces_path), "aligned")
    n = F.size("links").cast("bigint")
    return found.select(key, "n_a", "n_b", n.alias("n_groups"), n.alias("n_links"), agreement(found, pieces_path).alias("s"), "groups_sha256").select(key, "n_a", "n_b", "n_groups", "n_links", "s.n_best", "s.count_sum", "groups_sha256")
