"""N-best segmentation over the piece lattice of a SentencePiece vocabulary, and its inverse.

Forward Viterbi scores of the lattice are exact heuristics for a backward A-star search, which pops
segmentations in order of score. No piece has a space after another character (a vocabulary that has one is refused), so a
text's lattice falls apart before every run of spaces: each word has a lattice of its own, words are
searched once and kept, and a text's best segmentations combine those of its words.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released

#: The vocabulary file on the driver's machine; a parameter of all functions. It is sent to the workers.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Pieces with a score below this never take part (the vocabulary marks them so).
LEAST_SCORE = -1e8
#: A character without a piece costs this more than the worst piece, and is spelled in bytes.
UNKNOWN_COST = 10.0
#: So many words with their segmentations are kept by each worker; then, and when a task ends, it starts anew.
KEPT_WORDS = 500_000
#: Words up to this length are searched together.
LONGEST_TOGETHER = 40
#: Texts are encoded in slices of about so many bytes.
SLICE_BYTES = 2 << 20
BEST = 4

_WORD = re.compile(" +[^ ]*|[^ ]+")
ENCODED = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("score", "double").add("nbest", T.ArrayType(T.StructType().add("score", "double").add("n_pieces", "long").add("ids_sha256", "string")))
_NBEST = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string())]))


class Lattice:
    """Segmentations of one word. table: of each prefix of a piece its id (-1: a prefix only) and score."""

    def __init__(self, word: str, table: dict[str, tuple[int, float]], unknown: float):
        n = len(word)
        self.word, self.n, self.edges = word, n, []  # edges (from, to, id or -1, score), by their start
        best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for i in range(n):
            base, single = best[i], False
            for j in range(i + 1, n + 1):
                found = table.get(word[i:j])
                if found is None:
                    break
                piece, score = found
                if piece >= 0:
                    single |= j == i + 1
                    edge = (i, j, piece, score)
                    self.edges.append(edge)
                    if base + score > best[j]:
                        best[j], back[j] = base + score, edge
            if not single:
                edge = (i, i + 1, -1, unknown)
                self.edges.append(edge)
                if base + unknown > best[i + 1]:
                    best[i + 1], back[i + 1] = base + unknown, edge
        self.best, self.top = best, []
        while n:
            self.top.append(back[n])
            n = back[n][0]
        self.top.reverse()

    def gap(self) -> float:
        """What the second best segmentation costs more than the best: it has an edge that the best one lacks."""
        rest = [-math.inf] * self.n + [0.0]
        for i, j, _, score in reversed(self.edges):
            if score + rest[j] > rest[i]:
                rest[i] = score + rest[j]
        top = set(self.top)
        return self.best[self.n] - max((self.best[e[0]] + e[3] + rest[e[1]] for e in self.edges if e not in top), default=-math.inf)

    def segmentations(self, most: int):
        """The `most` best (score, edges) in falling order: A-star from the end to the start, the forward score being what remains.

        As that is exact, a hypothesis that is popped runs straight to the start along best edges, and leaves
        one hypothesis at each node that it passes, with the node's next edge. Each leads to a segmentation,
        so no more than are still wanted are kept. Of equal scores the one found first comes first, on every run.
        """
        into: list[list] = [[] for _ in range(self.n + 1)]
        for edge in self.edges:
            into[edge[1]].append(edge)
        for edges in into:
            edges.sort(key=lambda e: -(self.best[e[0]] + e[3]))
        tie = count()
        heap = [(-self.best[self.n], next(tie), self.n, 0, 0.0, None)]
        while heap and most:
            f, _, node, rank, done, tail = heap.pop(0)
            while node:
                if rank + 1 < len(into[node]):
                    edge = into[node][rank + 1]
                    heap.append((-(done + edge[3] + self.best[edge[0]]), next(tie), node, rank + 1, done, tail))
                    if len(heap) > 4096:
                        heap = heapq.nsmallest(most, heap)
                edge = into[node][rank]
                node, rank, done, tail = edge[0], 0, done + edge[3], (edge, tail)
            edges = []
            while tail is not None:
                edge, tail = tail
                edges.append(edge)
            yield -f, edges
            most -= 1
            heap = heapq.nsmallest(most, heap)


class _Slots:
    """Pieces by a 64-bit hash of their characters, in two tables, each piece in one of its two slots.

    A word whose best segmentation doesn't spell it, as a hash is no proof, is searched alone, by its characters."""

    MUL = np.uint64(0x9E3779B97F4A7C15)
    BITS = 18

    def __init__(self, scores: dict[str, tuple[int, float]]):
        self.longest = max(map(len, scores))
        self.power = [np.uint64(pow(int(self.MUL), k, 1 << 64)) for k in range(self.longest + 1)]
        slots = 2 << self.BITS  # and one more for what isn't found
        self.keys, self.ids, self.scores = np.zeros(slots + 1, np.uint64), np.full(slots + 1, -1, np.int32), np.full(slots + 1, -np.inf)
        self.passes = np.zeros(1 << 22, bool)
        for piece, (i, score) in scores.items():
            h = 0
            for c in piece:
                h = (h * int(self.MUL) + ord(c) + 1) % (1 << 64)
            entry = (h, i, score)
            self.passes[h >> 42] = True
            for turn in range(200):  # cuckoo: who is in the way moves to its other slot
                at = int(self._at(np.uint64(entry[0]), turn % 2))
                before = (int(self.keys[at]), int(self.ids[at]), float(self.scores[at]))
                self.keys[at], self.ids[at], self.scores[at] = entry
                if before[1] < 0:
                    break
                entry = before
            else:
                raise ValueError("the vocabulary is too large for its slots")

    def _at(self, h, table: int):
        with np.errstate(over="ignore"):
            return ((h * np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[table])) >> np.uint64(64 - self.BITS)).astype(np.int64) + (table << self.BITS)

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be of a piece: few others pass."""
        return np.flatnonzero(self.passes[(h >> np.uint64(42)).astype(np.int64)])

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; the last one where there is no piece."""
        a, b = self._at(h, 0), self._at(h, 1)
        return np.where(self.keys[a] == h, a, np.where(self.keys[b] == h, b, len(self.keys) - 1))


class Pieces:
    """A vocabulary with spaces for its space marks, and the words that were searched."""

    def __init__(self, path: str, best: int = BEST):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.plain: list[bytes] = [b""] * n
        self.bytes = [0] * 256
        self.scores: dict[str, tuple[int, float]] = {}
        for i in range(n):
            piece = model.IdToPiece(i)
            if model.IsByte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.plain[i] = bytes([int(piece[3:5], 16)])
            elif not (model.IsControl(i) or model.IsUnknown(i) or model.IsUnused(i)):
                self.plain[i] = piece.replace(SPACE, " ").encode()
                if model.GetScore(i) > LEAST_SCORE:
                    self.scores[piece.replace(SPACE, " ")] = (i, model.GetScore(i))
        if any(" " in p.lstrip(" ") for p in self.scores):
            raise ValueError("the vocabulary has pieces that span words")
        self.unknown = min(s for _, s in self.scores.values()) - UNKNOWN_COST
        self.table = {p[:k]: (-1, 0.0) for p in self.scores for k in range(1, len(p))} | self.scores
        self.best = best
        self.slots = _Slots(self.scores)
        self.ascii = np.array(self.bytes[:128], np.int32)
        self.forget()

    def forget(self) -> None:
        """Starts the store of searched words anew: ids, score and gap by place, and the places of words."""
        self.place: dict[str, int] = {}
        self.stored_ids: list[bytes] = []
        self.score, self.gap = np.zeros(0), np.zeros(0)
        self.kept_others: dict[str, list[tuple[float, bytes]]] = {}

    def ids(self, word: str, edges: list) -> bytes:
        out: list[int] = []
        for i, j, piece, _ in edges:
            out += [piece] if piece >= 0 else [self.bytes[b] for b in word[i:j].encode()]
        return np.array(out, "<i4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Searches words that aren't stored, those of one length together."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                ids, score, gap = self._searched(part, n) if n <= LONGEST_TOGETHER else self._alone(part)
                self.place |= zip(part, range(len(self.stored_ids), len(self.stored_ids) + len(part)), strict=True)
                self.stored_ids += ids
                self.score, self.gap = np.concatenate([self.score, score]), np.concatenate([self.gap, gap])

    def _alone(self, words: list[str]):
        every = [Lattice(w, self.table, self.unknown) for w in words]
        return [self.ids(w, x.top) for w, x in zip(words, every, strict=True)], np.array([x.best[x.n] for x in every]), np.array([x.gap() for x in every])

    def _searched(self, words: list[str], n: int):
        """What _alone gives, for words of one length: the same lattice with a column for each word."""
        m = len(words)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).astype(np.uint64)
        total = np.zeros((n + 1, m), np.uint64)
        for i in range(n):
            total[i + 1] = total[i] * _Slots.MUL + code[:, i] + np.uint64(1)
        best, rest = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        back, piece = np.zeros((n + 1, m), np.int16), np.zeros((n + 1, m), np.int32)
        best[0], rest[n] = 0.0, 0.0
        edges: list[list] = [[] for _ in range(n)]  # from each node: (to, words that have the edge, its score there)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.slots.longest), j):
                if j == i + 1:
                    words_at, ids, scores = slice(None), *self._single(code[:, i])
                else:
                    h = total[j] - total[i] * self.slots.power[j - i]
                    words_at = self.slots.maybe(h)
                    slot = self.slots.find(h[words_at])
                    scores, ids = self.slots.scores[slot], self.slots.ids[slot]
                    if not len(ids):
                        continue
                edges[i].append((j, words_at, scores))
                through = best[i][words_at] + scores
                up = through > best[j][words_at]
                if j == i + 1:
                    np.copyto(best[j], through, where=up)
                    np.copyto(back[j], np.int16(i), where=up)
                    np.copyto(piece[j], ids, where=up)
                else:
                    at = words_at[up]
                    best[j][at], back[j][at], piece[j][at] = through[up], i, ids[up]
        for i in range(n - 1, -1, -1):
            for j, words_at, scores in edges[i]:
                rest[i][words_at] = np.maximum(rest[i][words_at], scores + rest[j][words_at])
        on = np.zeros((n + 1, m), bool)
        on[n] = True
        each = np.arange(m)
        for j in range(n, 0, -1):
            on[back[j][on[j]], each[on[j]]] = True
        second = np.full(m, -np.inf)
        for i in range(n):
            for j, words_at, scores in edges[i]:
                through = np.where(on[j][words_at] & (back[j][words_at] == i), -np.inf, best[i][words_at] + scores + rest[j][words_at])
                second[words_at] = np.maximum(second[words_at], through)
        on, piece = on[1:].T, piece[1:].T
        flat = piece[on].astype("<i4").tobytes()
        ends = np.cumsum(on.sum(axis=1)).tolist()
        ids = [flat[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        score, gap = best[n].copy(), best[n] - second
        wrong = (on & (piece < 0)).any(axis=1)  # characters of several byte pieces
        spelled = lambda raw: b"".join(map(self.plain.__getitem__, np.frombuffer(raw, "<i4").tolist()))
        if wrong.any() or spelled(flat) != "".join(words).encode("utf-8", "surrogatepass"):
            wrong |= np.array([spelled(i) != w.encode("utf-8", "surrogatepass") for i, w in zip(ids, words, strict=True)])
        for k in np.flatnonzero(wrong).tolist():
            own_ids, own_score, own_gap = self._alone([words[k]])
            ids[k], score[k], gap[k] = own_ids[0], own_score[0], own_gap[0]
        return ids, score, gap

    def _single(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of single characters; one without a piece has its byte, or -1 if it has several."""
        slot = self.slots.find(code + np.uint64(1))
        scores, ids = self.slots.scores[slot], self.slots.ids[slot]
        lone = ids < 0
        if lone.any():
            scores = np.where(lone, self.unknown, scores)
            ids = np.where(lone & (code < 128), self.ascii[np.minimum(code, np.uint64(127)).astype(np.int64)], ids)
        return ids, scores

    def others(self, word: str) -> list[tuple[float, bytes]]:
        """(extra cost, ids) of the best - 1 segmentations of a word after its best one."""
        if word not in self.kept_others:
            lattice = Lattice(word, self.table, self.unknown)
            rest = [(lattice.best[lattice.n] - score, self.ids(word, edges)) for score, edges in lattice.segmentations(self.best) if edges != lattice.top]
            self.kept_others[word] = rest[: self.best - 1]
        return self.kept_others[word]

    def encode_all(self, texts: list[str]):
        """encode() of each text; the words that are new among them are searched together."""
        words = [_WORD.findall(" " + t) if t else [] for t in texts]
        if len(self.place) > KEPT_WORDS:
            self.forget()
        new = set(chain.from_iterable(words)).difference(self.place)
        if new:
            self.learn(list(new))
        return [self._encoded(w) for w in words]

    def encode(self, text: str) -> tuple[bytes, float, list[tuple[float, int, str]]]:
        """Ids (little-endian 32-bit), score, and the best segmentations as (score, pieces, SHA-256 of such ids)."""
        return self.encode_all([text])[0]

    def _encoded(self, words: list[str]):
        if not words:
            return b"", 0.0, []
        at = list(map(self.place.__getitem__, words))
        parts = list(map(self.stored_ids.__getitem__, at))
        ids, at = b"".join(parts), np.array(at)
        score, gaps = float(self.score[at].sum()), self.gap[at]
        nbest = [(score, len(ids) // 4, hashlib.sha256(ids).hexdigest())]
        # Another segmentation costs at least the smallest extra cost of each word that it changes: beyond the
        # best - 1 cheapest words (the first ones of equals) none belongs to the best.
        k = self.best - 1
        if len(gaps) > k > 0:
            limit = np.partition(gaps, k - 1)[k - 1]
            below = np.flatnonzero(gaps < limit)
            cheap = np.sort(np.concatenate([below, np.flatnonzero(gaps == limit)[: k - len(below)]]))
        else:
            cheap = np.arange(min(len(gaps), k))
        cheap = cheap[np.isfinite(gaps[cheap])].tolist()
        if cheap:
            others = [self.others(words[i]) for i in cheap]
            sizes = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            ends = sizes[cheap].tolist()
            for cost, choice in self._combined(others):
                pieces_, last = [], 0
                for i, end, take, other in zip(cheap, ends, choice, others, strict=True):
                    if take:
                        pieces_ += [ids[last : end - len(parts[i])], other[take - 1][1]]
                        last = end
                changed = b"".join([*pieces_, ids[last:]])
                nbest.append((score - cost, len(changed) // 4, hashlib.sha256(changed).hexdigest()))
        return ids, score, nbest

    def _combined(self, options: list[list[tuple[float, bytes]]]):
        """The cheapest choices over words (0: its best) but for the first, in order of cost, best - 1 at most."""
        start = (0,) * len(options)
        heap, seen, out = [(0.0, start)], {start}, []
        while heap and len(out) < self.best:
            cost, choice = heapq.heappop(heap)
            out.append((cost, choice))
            for w, k in enumerate(choice):
                if k < len(options[w]):
                    step = options[w][k][0] - (options[w][k - 1][0] if k else 0.0)
                    following = (*choice[:w], k + 1, *choice[w + 1 :])
                    if following not in seen:
                        seen.add(following)
                        heapq.heappush(heap, (cost + step, following))
        return out[1:]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.plain.__getitem__, ids.tolist())).decode()[1:]


def _int32(raw: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.int32(), len(raw) // 4, [None, pa.py_buffer(raw)])


@cache
def pieces(name: str, best: int) -> Pieces:
    """The vocabulary in a worker, by the name of the file that was sent."""
    return Pieces(SparkFiles.get(name), best)


def _sent(spark: SparkSession, path: str) -> str:
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL, best: int = BEST) -> DataFrame:
    """(key, text, ids, score, nbest) of each row: the best segmentation's ids and score, and the `best` best ones by digest.

    A null or empty text has no pieces, score 0 and no segmentations. White space is kept as it is; a
    character without a piece, a literal space mark too, becomes byte pieces, so decoding gives the same text.
    Repeated rows each have a row, an empty table has none; texts of any length are encoded whole; other columns are left out, so names
    can't clash. A vocabulary with pieces that span words is refused with ValueError.
    """
    out = T.StructType([docs.schema[key], docs.schema[text], *ENCODED.fields])
    name = _sent(docs.sparkSession, path)
    return docs.select(key, text).mapInArrow(released(_encoding(name, best, out.names)), out)


def _encoding(name: str, best: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(name, best)
        try:
            for batch in rows:
                yield from encoded(model, batch)
        finally:
            model.forget()  # the worker may wait long for its next task, or get one of another kind

    def encoded(model: Pieces, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = np.cumsum(pa.compute.binary_length(batch.column(1).fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            found = model.encode_all([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(np.fromiter((len(x[0]) // 4 for x in found), np.int64, b - a))])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _int32(b"".join([x[0] for x in found])))
            nbest = [[{"score": s, "n_pieces": n, "ids_sha256": h} for s, n, h in x[2]] for x in found]
            columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), ids, pa.array([x[1] for x in found], pa.float64()), pa.array(nbest, _NBEST)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return batches


def decode_udf(path: str = MODEL) -> Callable[[Column], Column]:
    """A Column function ids -> text; no or null ids give an empty text."""
    name = _sent(SparkSession.active(), path)

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        model = pieces(name, BEST)
        ids = ids.fill_null([]) if ids.null_count else ids
        flat, offsets = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False))])
        return pa.array([model.decode(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())

    return decode
