"""Fingerprints, edited texts and the search within a radius, against plain Python."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import fingerprints
from parlance.llm.common import Powers
from parlance.llm.queries import op13_fingerprints

from .corpus import AWKWARD, DOCS, documents


def table(spark, rows, path, files=5):
    spark.createDataFrame(rows, DOCS).repartition(files).write.parquet(f"{path}/documents.parquet")
    return str(path)


def edited(rows):
    """(id, n_chars, digest) by sorting all rows, text hashes from Spark's rows."""
    out = []
    for i, (key, text, _) in enumerate(rows):
        following, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        out.append((key, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("stretch", [8 << 20, 3000])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(fingerprints, "STRETCH_BYTES", stretch)  # the driver reads it
    rows = documents(9, 150) + AWKWARD + [(None, f"no key {i} " * 9, "en", "s", 0) for i in range(30)] + [(7, f"again {i % 3} seven", "en", "s", 0) for i in range(12)] + [(2**63 - 1, "largest", None, "s", 0), (-(2**63), "least", None, "s", 0)]
    path = table(spark, rows, tmp_path)
    hashes = {r.t: r.h for r in spark.createDataFrame([(r[1] or "",) for r in rows], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    order = sorted(((r[0], r[1] or "", hashes[r[1] or ""]) for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    got = op13_fingerprints(spark, path).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(edited(order), key=repr)
    fp = dict(zip(hashes, words_of(list(hashes)), strict=True))
    by_key = {}
    for r in got:
        by_key.setdefault(r.doc_id, set()).add(r.fingerprint)
    for key, text, _ in order:
        assert f"{fp[text][0]:016x}{fp[text][1]:016x}" in by_key[key]
    numbers = [int(r.fingerprint, 16) for r in got]
    for r in got:
        assert r.n_near == sum((int(r.fingerprint, 16) ^ x).bit_count() <= fingerprints.RADIUS for x in numbers) - 1
        assert r.near_edited == 1 - (int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).bit_count() / 128
    if stretch == 3000:
        docs = spark.read.parquet(f"{path}/documents.parquet")
        keys = docs.selectExpr("doc_id id", "xxhash64(coalesce(text, '')) h", "cast(coalesce(octet_length(text), 0) as bigint) bytes")
        bounds, before = fingerprints._stretches(keys)
        assert len(bounds) > 5 and len(before) > 5


def words_of(texts):
    return [(int(a), int(b)) for a, b in fingerprints.simhash(pa.array(texts, pa.large_string()), Powers())]


def test_votes_are_weighted_by_occurrence():
    """The bits of a text from those of its single terms: each alone votes with its own bits."""
    text, powers = "a b a b a c", Powers()
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = fingerprints.word_bounds(data, np.array([0, len(data)]), fingerprints.WORDS_BY_SPACE)
    w = fingerprints.word_hashes(data, s, e, powers)
    votes, terms = np.zeros(128), [*w, *fingerprints.window_hashes(w, 2)]
    for t in set(map(int, terms)):
        pair = np.array([t, int(fingerprints.mixed(np.array([t], np.uint64))[0])], np.uint64)
        votes += round(16 * (1 + math.log(sum(int(x) == t for x in terms)))) * (2.0 * np.unpackbits(pair.view(np.uint8), bitorder="little") - 1)
    assert np.packbits(votes > 0, bitorder="little").view(np.uint64).tolist() == list(words_of([text])[0])


def test_fingerprints_do_not_depend_on_the_batch(monkeypatch):
    texts = [r[1] or "" for r in documents(2, 90)] + ["word " * 50000, "", " ", "Ä ä A a"]
    alone = [words_of([t])[0] for t in texts]
    monkeypatch.setattr(fingerprints, "VOTES", 7)  # simhash runs here, in this process
    assert words_of(texts) == alone
    assert words_of(["AB c"]) == words_of(["ab  C\n"]) and words_of([" "]) == [(0, 0)]


def numbers(seed, families, members):
    """Distinct fingerprints: families that differ in few bits, and strangers."""
    rng, out = random.Random(seed), set()
    for _ in range(families):
        centre = rng.getrandbits(128)
        for _ in range(members):
            out.add(centre ^ sum({1 << rng.randrange(128) for _ in range(rng.randrange(7))}))
    return [*out, *(rng.getrandbits(128) for _ in range(200))]


@pytest.mark.parametrize("run", [1 << 14, 3])
@pytest.mark.parametrize("radius", [4, 1, 0])
def test_search_equals_all_pairs(spark, run, radius):
    found = numbers(radius, 4, 60)
    signed = lambda x: x - 2**64 if x >> 63 else x
    rows = [(signed(x >> 64), signed(x & 2**64 - 1), 1 + i % 3) for i, x in enumerate(found)]
    fps = spark.createDataFrame(rows, "hi long, lo long, copies long").repartition(7)
    got = {(r.hi, r.lo): r.n for r in fingerprints.within(fps, radius, run).collect()}
    want = {(signed(x >> 64), signed(x & 2**64 - 1)): sum(1 + j % 3 for j, y in enumerate(found) if x != y and (x ^ y).bit_count() <= radius) for x in found}
    assert got == want and (radius < 4 or sum(n > 0 for n in want.values()) > 100)
    if radius == 4:  # the bound on runs is taken, or not
        whole = fingerprints.Blocks(tuple(range(128)), radius + 2)
        kh, kl = fingerprints._masked(whole, fingerprints.F.col("t"))
        most = fps.select("hi", "lo", fingerprints.F.explode(fingerprints.F.sequence(fingerprints.F.lit(0), fingerprints.F.lit(14))).alias("t")).select("t", kh.alias("kh"), kl.alias("kl")).groupBy("t", "kh", "kl").count().agg({"count": "max"}).first()[0]
        assert most > 3


def test_empty_table_and_one_document(spark, tmp_path):
    assert op13_fingerprints(spark, table(spark, [], tmp_path / "a", 1)).count() == 0
    r = op13_fingerprints(spark, table(spark, [(5, "ab cd", None, None, 1)], tmp_path / "b", 1)).collect()
    assert [(x.doc_id, x.n_chars, x.near_next, x.n_near, x.edited_sha256) for x in r] == [(5, 5, 1.0, 0, hashlib.sha256(b"ab ab").hexdigest())]
