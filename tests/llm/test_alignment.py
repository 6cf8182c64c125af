"""Token alignment against both tokenizers' own token ends."""

import hashlib
from collections import Counter

import pytest

from parlance.llm import alignment
from parlance.llm.queries import op11_alignment

from .corpus import AWKWARD, DOCS, documents

EXTRA = ["lead  two   three ", "a▁b", "a\xa0b　 c", "<|endoftext|> <s> <0x41>", "日本語 漢字😀 x", "it's   we'll\n\n\tgo  ", "é ﬁ", "\x00 \x01", " ", "\n", "a" * 3000 + " b"]


def rows():
    found = documents(3) + AWKWARD + [(2000 + i, t, "en", "s", len(t)) for i, t in enumerate(EXTRA)]
    return found + [(3000, "two  words, then some more of them. " * 40, "en", "s", 0)]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTES_MODEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES_MODEL)


def tokens(both, text):
    """Ids of both with the ends of their bytes, or None."""
    a, b = both
    full = (" " + text).encode()
    table = {c: bytes([x]) for c, x in alignment._byte_of_char().items()}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    raw_a = [b"".join(table[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not text or b"".join(raw_a) != full or b"".join(raw_b) != full:
        return None
    ends = lambda raw: [sum(map(len, raw[: i + 1])) for i in range(len(raw))] if len(raw) < 2000 else list(_running(raw))
    return ids_a, ends(raw_a), ids_b, ends(raw_b)


def _running(raw):
    n = 0
    for r in raw:
        n += len(r)
        yield n


def expected(both, found):
    each, counts = [], Counter()
    for r in found:
        t = tokens(both, r[1] or "")
        each.append((r[0], t))
        if t:
            by_end = dict(zip(t[3], t[2], strict=True))
            counts.update((x, by_end[e]) for x, e in zip(t[0], t[1], strict=True) if e in by_end)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for key, t in each:
        if t is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, ea, b, eb = t
        shared = sorted(set(ea) & set(eb))
        groups, links, i0, j0 = [], [], 0, 0
        for e in shared:
            i, j = ea.index(e) + 1 if len(ea) < 5000 else _after(ea, e), eb.index(e) + 1 if len(eb) < 5000 else _after(eb, e)
            groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
            links.append((a[i - 1], b[j - 1]))
            i0, j0 = i, j
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((key, len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def _after(ends, e):
    import bisect

    return bisect.bisect_left(ends, e) + 1


def test_alignment_equals_brute_force(spark, tmp_path, tokenizers):
    spark.createDataFrame(rows(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op11_alignment(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(expected(tokenizers, rows()), key=repr)
    assert {r[0] for r in got if r[0] is not None and r[0] >= 1000 and r[1] == 0} == {1000, 1001, 1004, 2001}  # null, empty, with a literal space mark


def test_parts_and_forgotten_windows_change_nothing(tokenizers, monkeypatch):
    """The bounds of parts and of remembered windows, in this process, where they take effect."""
    texts = [r[1] for r in rows()] + ["\n" * 3000 + "x", " " * 3000, ". " * 900]
    shown = lambda found: [f and (f.n_a, f.n_b, f.digest.hexdigest(), b"".join(f.links)) for f in found]
    plain = shown(alignment.Tokenizers(alignment.BYTES_MODEL, alignment.PIECES_MODEL).align_all(texts, False))
    monkeypatch.setattr(alignment, "PART_CHARS", 50)
    monkeypatch.setattr(alignment, "TOGETHER_CHARS", 200)
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", 3)
    monkeypatch.setattr(alignment, "KEPT_TOKENS", 2)
    small = alignment.Tokenizers(alignment.BYTES_MODEL, alignment.PIECES_MODEL)
    assert shown(small.align_all(texts, False)) == plain
    assert all(len(k[0]) <= 8 for k in small.kept) and any(len(list(alignment._parts(" " + (t or "")))) > 10 for t in texts)
    for text, found in zip(texts, plain, strict=True):
        want = tokens(tokenizers, text or "")
        assert (found is None) == (want is None) and (found is None or found[:2] == (len(want[0]), len(want[2])))


def test_detail_spells_the_groups(spark):
    docs = spark.createDataFrame([(1, "unbelievable alignments\n", "clash", 5)], "doc_id long, text string, links string, n_a int")
    r = alignment.aligned(docs, detail=True).first()
    sizes, groups, i, j = list(zip(r.group_sizes[::2], r.group_sizes[1::2], strict=True)), [], 0, 0
    for x, y in sizes:
        groups.append(",".join(map(str, r.a_ids[i : i + x])) + "|" + ",".join(map(str, r.b_ids[j : j + y])))
        i, j = i + x, j + y
    assert (i, j) == (r.n_a, r.n_b) and hashlib.sha256(";".join(groups).encode()).hexdigest() == r.groups_sha256 and len(r.links) == len(groups)


def test_alignment_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert op11_alignment(spark, str(tmp_path)).count() == 0
