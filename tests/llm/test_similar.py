"""Similar documents against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import similar

from .corpus import AWKWARD, DOCS, documents, words
from .test_operators import LOWER, clashing


def shingles(text, k=5):
    w = (text or "").translate(LOWER).split()  # no white space beyond ASCII in the tests
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_groups(rows, least=0.8):
    """rows (id, text): id -> smallest id of its group."""
    sets, parent = {}, {}
    for i, t in rows:
        s = shingles(t)
        sets[s] = min(i, sets.get(s, i))

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    each = list(sets.items())
    for n, (s, i) in enumerate(each):
        for t, j in each[:n]:
            if min(len(s), len(t)) >= least * max(len(s), len(t)) and jaccard(s, t) >= least:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(sets[shingles(t)]) for i, t in rows}


def near_copies(rng, n, base, edits, size=120):
    """n texts, each some edits away from one of a few others."""
    seeds = [words(rng, size, 5000).split() for _ in range(base)]
    out = []
    for i in range(n):
        w = list(seeds[i % base])
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


WAYS = {
    "short": {},
    "blocks": {"bounds": similar.Bounds(short=4, block=16)},
    "hot": {"bounds": similar.Bounds(short=4, block=16, chunk=500)},
    "wide": {"layout": similar.WIDE},
}


@pytest.fixture(params=list(WAYS))
def way(request, monkeypatch):
    """Whole runs, runs in blocks, hot keys that are dealt to several tasks, and wider segments. The bounds are sent to the workers."""
    if request.param == "hot":
        monkeypatch.setattr(similar, "HOT_SHARE", 0.01)  # the driver reads it
    return WAYS[request.param]


@pytest.mark.parametrize("strangers", [1000, 5000, 20_000])
def test_a_near_pair_among_strangers_of_one_run(strangers):
    """Pairs whose sketches are 8 bits apart, in a run of rows that agree in a whole segment."""
    rng, found = np.random.default_rng(strangers), 0
    for _ in range(5):
        sketch = rng.integers(0, 1 << 63, strangers + 4, dtype=np.uint64) * np.uint64(2)
        for pair in (0, 2):
            flips = rng.choice(64, 8, replace=False)
            sketch[strangers + pair + 1] = sketch[strangers + pair] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
        at = rng.permutation(len(sketch))
        node = np.arange(len(sketch))
        a, b, _ = similar.linked(np.full(len(at), 5), node[at], sketch[at])
        pairs = set(zip(a.tolist(), b.tolist(), strict=True))
        found += sum((strangers + p, strangers + p + 1) in pairs for p in (0, 2))
    assert found >= 9, found


def test_bounds_of_runs_are_taken(monkeypatch):
    """The workers' function: chunks and blocks as small as asked for."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = np.sort(rng.integers(0, 6, 900) << 8), np.arange(900), rng.integers(0, 1 << 62, 900)
    sizes, chunks = [], []
    monkeypatch.setattr(similar, "spanning", lambda s, real=similar.spanning: sizes.append(len(s)) or real(s))
    monkeypatch.setattr(similar, "linked", lambda *x, real=similar.linked: chunks.append(len(x[0])) or real(*x))
    batches = lambda: iter([pa.record_batch([pa.array(c[i : i + 50]) for c in rows], schema=similar._BAND) for i in range(0, 900, 50)])
    [*similar._links(similar.Layout(), similar.Bounds())(batches())]
    assert chunks == [900] and max(sizes) > 100
    sizes.clear(), chunks.clear()
    [*similar._links(similar.Layout(), similar.Bounds(short=4, block=16, chunk=100))(batches())]
    assert len(chunks) > 4 and max(sizes) == 16


def test_rows_that_repeat_stay_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words of its own here"), (3, "and more of them in this row"), (None, "x"), (None, "x")], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in similar.deduplicate(docs).collect())
    assert got == {(1, "a b c d e f g"): 1, (3, "other words of its own here"): 1, (3, "and more of them in this row"): 1, (None, "x"): 2}


def test_groups_equal_brute_force_on_near_copies(spark, way):
    rng = random.Random(21)
    texts = near_copies(rng, 150, 30, 3) + near_copies(rng, 80, 1, 2) + [words(rng, 60) for _ in range(40)]
    texts += texts[:7] + [t.upper() for t in texts[7:12]] + [t.replace(" ", "\n ") for t in texts[12:15]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), **way).collect()}
    want = brute_groups(rows)
    joined = {(want[i], got[i]) for i in got}
    assert len(got) == len(rows) and len({g for _, g in joined}) == len(joined), "a link below the similarity"
    assert len(joined) - len(set(want.values())) <= 0.02 * (len(rows) - len(set(want.values()))), "links that are missed"
    assert all(got[g] == g <= i for i, g in got.items())


def families(rng, n, base):
    """n texts that keep different parts of a few others: hardly two are equal, many are just similar enough or just not."""
    seeds = [words(rng, 130, 5000).split() for _ in range(base)]
    out = []
    for i in range(n):
        w = list(seeds[i % base])
        for at in rng.sample(range(len(w)), rng.randrange(1, 5)):
            w[at] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w[rng.randrange(12) :]))
    return out


@pytest.mark.parametrize("way", ["short", "blocks", "cells"])
def test_no_link_is_missed(spark, way, monkeypatch):
    """Groups equal brute force, however runs are cut: where the search by signatures is cut or finds nothing, the exact one finds the rest."""
    rng = random.Random(31)
    texts = families(rng, 240, 2) + families(rng, 60, 20) + [words(rng, 60) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    bounds = {"short": similar.Bounds(), "blocks": similar.Bounds(short=4, block=16, chunk=100), "cells": similar.Bounds(short=4, block=16, chunk=100)}[way]
    if way == "cells":
        monkeypatch.setattr(similar, "candidates", lambda nodes, *_: nodes.sparkSession.createDataFrame([], similar.LINK))
        monkeypatch.setattr(similar, "SENT_KEYS", 0)
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), bounds=bounds).collect()}
    assert got == brute_groups(rows)


def test_parities_and_first_shingles_leave_out_no_similar_pair():
    rng = np.random.default_rng(7)
    for _ in range(300):
        n, gone, new = rng.integers(4, 400), rng.integers(0, 40), rng.integers(0, 40)
        x = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        y = np.unique(np.concatenate([x[min(gone, len(x) - 1) :], rng.integers(-(1 << 62), 1 << 62, new)]))
        flat, sizes = np.concatenate([x, y]), np.array([len(x), len(y)])
        known = np.unique(rng.choice(flat, 50))
        row, first = similar.first_shingles(flat, sizes, similar.Order(known, rng.permutation(len(known)) + 1), 0.8)
        parity = similar.parities(flat, sizes)
        differ = len(np.setxor1d(x, y))
        assert np.bitwise_count(parity[0] ^ parity[1]).sum() <= differ
        if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
            assert len(np.intersect1d(first[row == 0], first[row == 1]))


def test_links_at_the_threshold_are_mostly_found(spark):
    """Pairs that are 0.8 to 0.85 alike, each alone."""
    rng = random.Random(22)
    rows, pairs = [], []
    while len(pairs) < 150:
        w = words(rng, 100, 10**6).split()
        v = list(w)
        for at in rng.sample(range(10, 90), 2):
            v[at] = "changed"
        if 0.8 <= jaccard(shingles(" ".join(w)), shingles(" ".join(v))) < 0.85:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_similar_documents_on_awkward_rows(spark):
    rows = documents(n=60) + AWKWARD
    docs = clashing(spark.createDataFrame(rows, DOCS))
    found = Counter((r.doc_id, r.component_id) for r in similar.similar_documents(docs).collect())
    assert sum(found.values()) == sum(r[0] is not None for r in rows)
    assert found[1003, 1003] == 2
    by = dict(found.keys())
    assert by[1000] == by[1001] == by[1002]  # no words
    want = brute_groups([(r[0], r[1]) for r in rows if r[0] is not None])
    assert len({(want[i], by[i]) for i in by}) == len(set(by.values()))
    kept = similar.deduplicate(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(by.values()) | {None}
    assert kept.filter("doc_id = 1003").count() == 1  # one of the rows that repeat
    empty = spark.createDataFrame([], DOCS)
    assert similar.deduplicate(empty).count() == 0 and similar.similar_documents(empty).count() == 0


def test_spanning_forest_is_minimal():
    rng = np.random.default_rng(5)
    for n in (1, 2, 30, 90):
        sketch = rng.integers(0, 1 << 63, 4, dtype=np.uint64)[rng.integers(0, 4, n)]
        for _ in range(6):
            sketch = sketch ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        x, y = similar.spanning(sketch)
        d = np.bitwise_count(sketch[:, None] ^ sketch[None, :]).astype(int)
        parent, cost = list(range(n)), 0

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for w, i, j in sorted((d[i, j], i, j) for i in range(n) for j in range(i)):
            if w <= similar.NEAR and root(i) != root(j):
                parent[root(i)], cost = root(j), cost + w
        assert d[x, y].sum() == cost and len(x) == n - len({root(i) for i in range(n)})


@pytest.mark.parametrize("layout", [similar.Layout(), similar.WIDE])
def test_bands_hold_each_byte_once_as_wildcard(spark, layout):
    width, rng = layout.width, random.Random(3)
    sig = bytes(rng.randrange(256) for _ in range(layout.size))
    bands = [r.band for r in spark.createDataFrame([(1, bytearray(sig))], "node long, sig binary").mapInArrow(similar._bands(layout), similar.BAND).collect()]
    assert len(bands) == width * layout.segments == len({b >> 8 * width for b in bands})
    for b in bands:
        at, p = divmod(b >> 8 * width, width)
        own = sig[width * at : width * at + width]
        assert b & 255 == own[p] and (b & (1 << 8 * width) - 1).to_bytes(width, "big") == own[p + 1 :] + own[: p + 1]


def test_pairs_are_not_emitted_within_a_group(spark):
    rng = random.Random(23)
    texts = near_copies(rng, 600, 1, 2)
    nodes = spark.createDataFrame([(i, similar.signature(s, similar.seeds(similar.Layout().size)).tobytes()) for i, s in enumerate(_sets(texts))], "node long, sig binary")
    assert similar.candidates(nodes).agg(F.count("*")).first()[0] < 2 * 600 * similar.Layout().segments  # a forest of those that agree, and its links to others


def _sets(texts):
    import pyarrow as pa

    return list(similar._sets(pa.array(texts), 5))


def test_counters_leave_pairs_of_long_sets_out_but_no_similar_one(spark):
    rng = random.Random(8)
    texts = near_copies(rng, 2, 1, 60, 3000) + near_copies(rng, 2, 1, 0, 3000)
    texts[2] = " ".join(texts[0].split()[:300] + texts[2].split()[300:])  # a passage in common, which parities can't tell from a copy
    ids = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    nodes = ids.select(F.col("id").alias("node"), similar._signed(5, similar.Layout())(F.col("text")).alias("s")).select("node", "s.digest", "s.n")
    pairs = spark.createDataFrame([(a, b) for b in range(4) for a in range(b)], "a long, b long")
    assert jaccard(shingles(texts[0]), shingles(texts[1])) >= 0.8 > 0.8 * jaccard(shingles(texts[2]), shingles(texts[3])) > 0.5
    left = {tuple(r) for r in similar.possible(ids, pairs, nodes, 5, 0.8).collect()}
    assert left == {(0, 1), (2, 3)}
    for n in (3, 700, 200_000):  # the last one's counters overflow
        x = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        y = np.concatenate([x[n // 9 :], x[: n // 9] + np.uint64(1)])
        assert np.abs(similar.tally(x).astype(int) - similar.tally(y)).sum() <= 2 * (n // 9)


def python_nodes(plan):
    """The most Python nodes on a path of a plan, as text, that no exchange parts: so many workers a task has at once."""
    open_, most = [], 0
    for line in plan.splitlines():
        name = line.lstrip(" :+-")
        depth = len(line) - len(name)
        open_ = [x for x in open_ if x[0] < depth]
        n = 0 if "Exchange" in name.split(" ")[0] else (open_[-1][1] if open_ else 0) + name.startswith(("ArrowEvalPython", "MapInArrow"))
        open_.append((depth, n))
        most = max(most, n)
    return most


def test_sets_are_made_once_a_row_by_one_worker_a_task(spark, monkeypatch):
    """No filter by a function's result, which Spark calls twice, and no sets that go from one worker to another."""
    assert python_nodes("A\n+- MapInArrow f\n   +- Exchange x\n      +- ArrowEvalPython [g]\n         +- Project\n            +- ArrowEvalPython [g]") == 2
    seen = {}

    def stored(df, name, real=similar.stored):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen[name] = max(seen.get(name, 0), python_nodes(plan))
        return real(df, name)

    monkeypatch.setattr(similar, "stored", stored)
    ids = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g i"), (3, "x y")], "id long, text string")
    nodes = ids.select(F.col("id").alias("node"), similar._signed(5, similar.Layout())(F.col("text")).alias("s")).select("node", "s.digest", "s.n", "s.parity").localCheckpoint()
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert {r.node: len(r.shingles) for r in similar._sets_of(ids, pairs, nodes, 5).collect()} == {1: 4, 2: 4}
    assert similar.possible(ids, pairs, nodes, 5, 0.5).count() == 1
    assert [tuple(r) for r in similar.missed(ids, nodes, spark.createDataFrame([], "node long, root long"), 5, 0.5).collect()] == [(1, 2)]
    assert {"shingles", "tally", "postings", "shared-shingles"} <= seen.keys() and max(seen.values()) == 1, seen


def test_texts_without_the_digest_have_no_set(spark):
    """Of rows that repeat a key, the one with the digest counts."""
    rows = [(1, "a b c d e f"), (1, "other words of its own here"), (2, None), (3, "")]
    ids = spark.createDataFrame(rows, "id long, text string")
    digests = [(1, similar.digest(_sets([rows[0][1]])[0])), (2, similar.digest(_sets([None])[0])), (3, b"none")]
    nodes = spark.createDataFrame([(n, bytearray(d)) for n, d in digests], "node long, digest binary")
    got = similar._sets_of(ids, spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), nodes, 5).collect()
    assert {r.node: r.shingles for r in got} == {1: _sets([rows[0][1]])[0].view(np.int64).tolist(), 2: []}


def test_keys_of_sets_are_the_same_in_sql_and_in_workers(spark):
    sets = [np.arange(n, dtype=np.uint64) for n in range(200)]
    digests = spark.createDataFrame([(i, bytearray(similar.digest(x))) for i, x in enumerate(sets)], "i int, d binary")
    got = {r.i: r.k for r in digests.select("i", similar.set_key(F.col("d")).alias("k")).collect()}
    want = similar.set_keys(sets).tolist()
    assert [got[i] for i in range(200)] == want and min(want) < 0 < max(want)


def test_parities_compared_in_pieces_leave_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(12)
    n = 300
    parity = rng.integers(0, 1 << 62, (6, similar.PARITIES // 64)).astype(np.uint64)[rng.integers(0, 6, n)]
    parity[:, 0] ^= np.uint64(1) << rng.integers(0, 60, n).astype(np.uint64)
    cells = similar.Cells(np.sort(rng.integers(0, 4, n)), np.full(n, similar.BOTH), np.arange(n), np.arange(n) // 3, np.full(n, 40), parity)
    pairs = lambda: {tuple(sorted(p)) for a, b in similar.apart(cells, 0.8, 16) for p in zip(a.tolist(), b.tolist(), strict=True)}
    whole = pairs()
    monkeypatch.setattr(similar, "COMPARED", 7)
    assert len(whole) > 100 and pairs() == whole


def test_texts_that_share_a_passage_are_told_apart_in_the_task(spark):
    """Long texts with a passage in common with the next one: only those that are similar come out of the cells. 512 bits let all pairs of them through."""
    rng = random.Random(51)
    passages = [words(rng, 250).split() for _ in range(10)]  # each in two texts, so none is popular
    texts = [passages[i] + words(rng, 2300).split() + passages[i + 1] for i in range(9)]
    near = texts[0][:]
    for k in range(0, len(near), 70):
        near[k] = "edited"
    ids = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*texts, near])], "id long, text string").localCheckpoint()
    nodes = ids.select(F.col("id").alias("node"), similar._signed(5, similar.Layout())(F.col("text")).alias("s")).select("node", "s.digest", "s.n", "s.parity").localCheckpoint()
    assert [tuple(r) for r in similar.missed(ids, nodes, spark.createDataFrame([], "node long, root long")).collect()] == [(0, 9)]


def test_places_and_longer_parities_leave_out_no_similar_pair():
    """All sets in all their cells: each similar pair is met, in the cell of the first shingle that both have, and few others."""
    import pyarrow as pa

    rng = np.random.default_rng(52)
    sets = []
    for size in (9, 60, 130, 700, 2500):
        base = rng.integers(-(1 << 62), 1 << 62, size)
        for k in range(8):
            own = base.copy()
            own[rng.random(size) < 0.03 * k] = rng.integers(1 << 62)
            sets.append(np.unique(np.concatenate([own, rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 1 + size // 12))])))
    n = np.array([*map(len, sets)])
    row, first = similar.first_shingles(np.concatenate(sets), n, similar.Order(np.zeros(0, np.int64), np.zeros(0, np.int64)), 0.8)
    place = np.arange(len(row)) - np.searchsorted(row, row)
    order = np.lexsort((row, first))
    row, cell, place = row[order], first[order], place[order]
    wide = similar.Parities.of(pa.chunked_array([pa.array([similar.parities(sets[i], n[i : i + 1], similar.parity_bits(len(sets[i]))).tobytes() for i in row], pa.binary())]))
    assert np.array_equal(wide.folded(np.arange(len(row)), similar.PARITIES // 64)[0], similar.parities(sets[row[0]], n[row[:1]]).view(np.uint64)[0])
    given = cell, np.full(len(row), similar.BOTH), row, row, n[row], wide.folded(np.arange(len(row)), similar.PARITIES // 64)
    found = [[tuple(sorted(p)) for a, b in similar.apart(similar.Cells(*given, *more), 0.8, 16) for p in zip(a.tolist(), b.tolist(), strict=True)] for more in ((), (place, wide))]
    shared = lambda x, y: len(np.intersect1d(sets[x], sets[y]))
    want = {(x, y) for x in range(len(sets)) for y in range(x + 1, len(sets)) if shared(x, y) >= 0.8 * (n[x] + n[y] - shared(x, y))}
    assert len(want) > 20 and want <= set(found[1]) <= set(found[0])
    assert len(found[1]) < len(found[0]) / 2
