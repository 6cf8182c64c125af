"""Fill-in-the-middle against plain slicing and against its SQL."""

import hashlib
import re

import numpy as np
import pytest

from parlance.llm import infill
from parlance.llm.oracles import ORACLES
from parlance.llm.queries import op12_fill_in_middle

from .corpus import AWKWARD, DOCS, documents

EXTRA = ["a<P>b", "<", "<P", "S>x<", "é漢😀" * 50, "\n\n a\n b  c\n", "a" * 3000, "<<<>>><S", "x<M>", "\x00a\x00", "🤦🏼‍♂️é" * 9]


def rows():
    return documents(5, 120) + AWKWARD + [(2000 + i, t, "en", "s", 0) for i, t in enumerate(EXTRA * 8)]


def plain(key, text):
    text = text or ""
    n, s = len(text), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    a, b, z = text[:p], text[p:q], text[q:]
    out = {"plain": text, "psm": f"<P>{a}<S>{z}<M>{b}", "spm": f"<S>{z}<P>{a}<M>{b}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return key, n, form, None if form == "plain" else p, None if form == "plain" else q - p, sha(out), sha(text)


def test_query_equals_slicing_and_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame(rows(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op12_fill_in_middle(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((plain(r[0], r[1]) for r in rows()), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.execute(ORACLES["op12_fill_in_middle"]).fetchall(), key=repr)


def test_empty_table_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_fill_in_middle(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, "some text here", "x", 1, "y")], "doc_id long, text string, form string, n int, output string")
    assert infill.fill_in_middle(docs).columns == ["doc_id", "n", "form", "prefix_units", "middle_units", "output"]


def starts(text, unit):
    if unit == "chars":
        return list(range(len(text)))
    if unit == "words":
        return [m.start() for m in re.finditer(r"[^ \t-\r]+", text)]
    return [0] + [m.end() for m in re.finditer("\n", text) if m.end() < len(text)] if text else []


@pytest.mark.parametrize("unit", ["chars", "words", "lines"])
def test_cuts_of_units(unit):
    texts = ["", *EXTRA, " a b\nc  d\n\n", "one", "é\nà la\n"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    bounds = infill.Boundaries(np.frombuffer(b"".join(raw), np.uint8), offsets, unit)
    assert bounds.units.tolist() == [len(starts(t, unit)) for t in texts]
    for k in range(12):
        want = []
        for t in texts:
            s = starts(t, unit)
            want.append(len(t[: 0 if k == 0 else len(t) if k >= len(s) else s[k]].encode()))
        assert (bounds.place(np.full(len(texts), k)) - offsets[:-1]).tolist() == want


def test_ranks_equal_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        seq = rng.integers(0, 5, n).astype(np.uint8)
        m, at = infill.WaveletMatrix(seq, 3), np.arange(n + 1)
        for c in range(5):
            assert m.rank(c, at).tolist() == [0, *np.cumsum(seq == c).tolist()]


@pytest.mark.parametrize("unit", ["words", "lines"])
def test_other_units_are_restored(spark, unit):
    docs = spark.createDataFrame([r for r in rows() if r[0] is not None], DOCS)
    found = infill.fill_in_middle(docs, unit=unit)
    back = found.select("doc_id", infill.restored(found.output, found.form).alias("text"))
    assert sorted(map(tuple, back.collect())) == sorted((r[0], r[1] or "") for r in rows() if r[0] is not None)
    with pytest.raises(ValueError, match="unit"):
        infill.fill_in_middle(docs, unit="pages")
