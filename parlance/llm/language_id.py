"""Language spans: scripts narrow the candidates, words are scored by letter trigrams, a Viterbi path with a
penalty for each switch labels the words, and the language of most letters is the prediction.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, released

#: The classifier learns from about so many labelled rows at most, a share of all by the hash of their id,
MAX_TRAIN_DOCS = 20_000
#: and all of their labels. The model has MODEL_NUMBERS numbers: with more labels letters share fewer buckets, LEAST_BUCKETS at least.
MODEL_NUMBERS = 1 << 24
BUCKETS, LEAST_BUCKETS = 1 << 16, 1 << 10
#: Cost of a switch of language between two words, in nats.
SWITCH = 20.0
#: A script is open to a language that writes at least this share of its words in it.
SCRIPT_SHARE = 0.002
UNKNOWN = "und"
#: Words are scored in slices of about so many characters.
SLICE_CHARS = 1 << 19

# Blocks of code points of each script, after the Unicode Standard.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "burmese": [(0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)],
    "cherokee": [(0x13A0, 0x13FF), (0xAB70, 0xABBF)],
    "khmer": [(0x1780, 0x17FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
OTHER = len(SCRIPTS)

RESULT = T.StructType().add("lang", "string").add("score", "double").add("spans", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("lang", "string")))
_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is a letter, its lower case, its script, is a mark (a vowel sign, an accent), which goes on with a word."""
    n = 0x110000
    mark = np.zeros(n, bool)
    for c in (*range(0x300, 0x20000), *range(0xE0100, 0xE01F0)):  # the planes that have marks
        mark[c] = unicodedata.category(chr(c)) in ("Mn", "Mc")
    letter = np.fromiter((chr(c).isalpha() for c in range(n)), bool, n)
    lower = np.arange(n, dtype=np.uint32)
    for c in range(0x1E944):  # above it there is no letter case
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    script = np.full(n, OTHER, np.uint8)
    for i, blocks in enumerate(SCRIPTS.values()):
        for a, b in blocks:
            script[a : b + 1] = i
    return letter, lower, script, mark


def _words(texts: list[str], buckets: int):
    """Of all words of the texts: first letter's place among the letters, text, start, end, script; and the bucket of each letter's trigram."""
    letter, lower, script, mark = _tables()
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    n = len(code)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = letter[code]
    cut = np.zeros(n + 2, bool)
    cut[offsets + 1] = True  # a text starts here: what stands before is no neighbour
    marks = np.flatnonzero(mark[code]) + 1
    if len(marks):  # a mark goes on with a word, it starts none
        place = np.arange(n + 2)
        joins = inside.copy()
        joins[marks] = True
        since = np.maximum.accumulate(np.where(cut | ~joins, place, 0))  # where its text or its run starts
        inside[marks] = np.maximum.accumulate(np.where(inside, place, 0))[marks] >= since[marks]
    at = np.flatnonzero(inside)
    low = np.zeros(n + 2, np.uint64)
    low[1:-1] = lower[code]
    low[~inside] = 0
    left = np.where(cut[at], 0, low[at - 1])
    right = np.where(cut[at + 1], 0, low[at + 1])
    gram = (mixed((left << np.uint64(42)) ^ (low[at] << np.uint64(21)) ^ right) & np.uint64(buckets - 1)).astype(np.int64)
    first = np.flatnonzero(left == 0)
    starts = at[first] - 1
    ends = at[np.concatenate([first[1:], [len(at)]]) - 1] if len(first) else starts
    return first, np.searchsorted(offsets, starts, "right") - 1, starts, ends, script[code[starts]], gram, offsets


def _slices(texts: list[str], most: int = SLICE_CHARS):
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _counts(langs: dict[str, int], buckets: int) -> Callable:
    width = buckets + OTHER + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, of = batch.column(0).to_pylist(), np.array([langs[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b in _slices(texts):
                first, row, _, _, script, gram, _ = _words(texts[a:b], buckets)
                word_lang = of[a:b][row] * width
                letters = np.diff(np.concatenate([first, [len(gram)]]))
                found, n = np.unique(np.concatenate([np.repeat(word_lang, letters) + gram, word_lang + buckets + script]), return_counts=True)
                yield pa.record_batch([pa.array((found // width).astype(np.int32)), pa.array((found % width).astype(np.int32)), pa.array(n)], ["lang", "feature", "n"])

    return count


class Model:
    """langs in order of their frequency; log probabilities by bucket; which script is open to which language."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = grams.sum(axis=1, keepdims=True)
        self.table = np.empty((grams.shape[1], len(langs)), np.float32)
        for i, own in enumerate(grams):
            self.table[:, i] = np.log((own + 0.1) / (total[i] + 0.1 * grams.shape[1]))
        self.open = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.open &= scripts > 0
        self.buckets = grams.shape[1]


def buckets_for(labels: int) -> int:
    """A power of two: BUCKETS for up to 256 labels, then as many as keep the model at MODEL_NUMBERS, down to LEAST_BUCKETS."""
    return max(LEAST_BUCKETS, min(BUCKETS, 1 << (MODEL_NUMBERS // max(1, labels)).bit_length() - 1))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = MAX_TRAIN_DOCS) -> Model:
    """Learns all labels of the rows with a text and a label, of a bounded sample of them. A label is learned only if a letter taught it.
    Driver and broadcast get MODEL_NUMBERS numbers, up to 16384 labels; the sample has no more labels than rows."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang)
    share = max(1, math.ceil(rows.count() / most))
    sample = rows.filter(F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(share)) == 0).select(text, lang)
    by_lang = sample.groupBy(lang).count().orderBy(F.desc("count"), lang).collect()  # the sample's rows bound it
    langs = {r[lang]: i for i, r in enumerate(by_lang)}
    buckets = buckets_for(len(langs))
    grams = np.zeros((len(langs), buckets + OTHER + 1), np.int32)
    if langs:
        found = sample.mapInArrow(released(_counts(langs, buckets)), "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
        grams[found["lang"].to_numpy(), found["feature"].to_numpy()] = found["n"].to_numpy()
    taught = grams.any(axis=1)
    return Model([x for x, good in zip(langs, taught.tolist(), strict=True) if good], grams[taught, :buckets], grams[taught, buckets:])


def path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best sequence of columns through the rows of scores, each change costing `switch`."""
    n, k = scores.shape
    best, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(best)
        at, low = best.index(top), top - switch
        back.append((at, [b >= low for b in best]))
        best = [(b if b >= low else low) + s for b, s in zip(best, row, strict=True)]
    at = best.index(max(best))
    out = [at]
    for top, stays in reversed(back):
        if not stays[at]:
            at = top
        out.append(at)
    return np.array(out[::-1])


def _label(scores: np.ndarray, switch: float) -> np.ndarray | int:
    """The path; just its column if it never switches, which is so if no stretch of words gains half a switch over the best column."""
    total = scores.sum(axis=0, dtype=np.float64)
    top = int(total.argmax())
    gain = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores - scores[:, top : top + 1], axis=0, out=gain[1:])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= switch / 2:
        return top
    return path(scores, switch)


def _predict(model: Model, texts: list[str | None], switch: float) -> list[dict]:
    nothing = {"lang": UNKNOWN, "score": 0.0, "spans": []}
    out = [nothing] * len(texts)
    if not model.langs:
        return out
    plain = [t or "" for t in texts]
    for a, b in _slices(plain, SLICE_CHARS * 256 // max(256, len(model.langs))):  # a row of scores has a number for each label
        first, row, starts, ends, script, gram, offsets = _words(plain[a:b], model.buckets)
        if not len(first):
            continue
        scores = np.add.reduceat(model.table[gram], first, axis=0)
        allowed = model.open[:, script].T
        none = ~allowed.any(axis=1)
        scores[~allowed & ~none[:, None]] -= 4 * switch  # another script
        scores[none] = 0  # no language is known to use the script
        letters = np.diff(np.concatenate([first, [len(gram)]]))
        begins = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
        for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(row)], strict=True):
            r, own = int(row[i]), scores[i:j]
            label = _label(own, switch)
            total = own.sum(axis=0, dtype=np.float64)
            if isinstance(label, int):
                top, share, ranges = label, 1.0, [(i, j, label)]
            else:
                weight = np.bincount(label, weights=letters[i:j], minlength=len(model.langs))
                top = int(weight.argmax())
                share = float(weight[top] / weight.sum())
                cuts = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), j - i]
                ranges = [(i + x, i + y, int(label[x])) for x, y in zip(cuts, cuts[1:], strict=False)]
            rest = np.delete(total, top)
            margin = max(0.0, float(total[top] - rest.max())) if len(rest) and share == 1.0 else math.inf
            sure = 1.0 if math.isinf(margin) else 1.0 - math.exp(-margin)
            if none[i:j].all():
                sure = 0.0
            spans = [{"start": int(starts[x] - offsets[r]), "end": int(ends[y - 1] - offsets[r]), "lang": model.langs[k]} for x, y, k in ranges]
            out[a + r] = {"lang": model.langs[top], "score": share * sure, "spans": spans}
    return out


def language_udf(docs: DataFrame, model: Model, switch: float = SWITCH) -> Callable[[Column], Column]:
    """A Column function text -> RESULT: language, score from 0 to 1, and spans of letters by language.

    A text without letters, or a null one, has the language "und", score 0 and no spans. If no language writes
    a text's scripts, the most frequent one is named with score 0. Spans are in code points, end exclusive.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(predictions)(batches)

    def predictions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(_predict(held.value, texts.to_pylist(), switch), _RESULT)

    return language


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: CRC-32 of its id as text, modulo 4, is 2. Null ids aren't."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang, score, spans) of each document, learned from the labelled ones that aren't held out.

    Null and empty texts and those without a letter are "und"; so are all if there is no label to learn from. Repeated rows each get a
    row, an empty table gives none; texts of any length are read whole; other columns are left out, so names can't clash.
    """
    model = train(docs.filter(F.col(key).isNotNull() & ~held_out(F.col(key))), text, lang, key)
    found = docs.select(key, language_udf(docs, model)(F.col(text)).alias("_l"))
    return found.select(key, held_out(F.col(key)).alias("held_out"), "_l.lang", "_l.score", "_l.spans")
