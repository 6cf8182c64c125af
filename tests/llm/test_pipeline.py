"""The pipeline against a plain version of its stages."""

import os
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from parlance.llm import common
from parlance.llm import pieces as pc
from parlance.llm import pii

from .corpus import AWKWARD, DOCS, documents
from .test_operators import brute_contamination
from .test_similar import brute_groups

ITEMS = [(1, "w1x w2x"), (2, "a benchmark passage of more than ten words that stands in a document")]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = documents(seed=3, n=50) + [r for r in AWKWARD if r[0] != 1003] + [(2000, f"Start {ITEMS[1][1]} end", "en", "s", 1), (2001, "write to a.b@example.org or 10.0.0.1 now", "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(r[0], r[1]) for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    of = brute_groups([(i, t) for i, t in kept if i is not None])
    kept = [(i, t) for i, t in kept if i is None or of[i] == i]
    kept = [(i, t) for i, t in kept if brute_contamination(t, ITEMS)[1] == 0]
    model = pc.Pieces(pc.MODEL, pc.BEST)
    want = {}
    for i, t in kept:
        ids, score, _ = model.encode(pii.redacted(t, 0.5))
        want[i] = (np.frombuffer(ids, "<i4").tolist(), score)
    got = {r.doc_id: (r.ids, r.score) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 2000 not in got and 2001 in got
    assert "[EMAIL]" in model.decode(np.array(got[2001][0]))


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(documents(n=12), DOCS)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_language_stage_rejects_scripts_that_no_language_writes(spark, tmp_path):
    rows = [(i, f"the cat number {i} sat on the mat", "en", "s", 1) for i in range(40)] + [(i + 40, "кот сидит на ковре", "ru", "s", 1) for i in range(40)]
    odd = [(100, "แมวนั่งบนเสื่อ", None, "s", 1), (101, "חתול על מחצלת", None, "s", 1), (102, "12 !!", None, "s", 1), (103, "", None, "s", 1), (104, None, None, "s", 1)]
    docs = spark.createDataFrame([*rows, *odd, (105, "a cat แมว", None, "s", 1), (None, "кот", None, "s", 1)], DOCS)
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == {*range(80), 105, None}


def test_a_task_leaves_no_searched_words_in_its_worker(spark):
    pc.encode(spark.createDataFrame(documents(n=40), DOCS).repartition(8)).collect()
    name = os.path.basename(pc.MODEL)

    def held(batches):
        for _ in batches:
            pass
        yield pa.record_batch([pa.array([len(pc.pieces(name, pc.BEST).place)])], ["n"])

    assert {r.n for r in spark.range(64).repartition(16).mapInArrow(held, "n long").collect()} == {0}


def test_freed_memory_goes_back_when_a_task_ends_or_breaks_off(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    assert [*common.released(iter)([1, 2])] == [1, 2] and calls == [1]
    broken = common.released(lambda rows: (1 // r for r in rows))([1, 0])
    assert next(broken) == 1 and calls == [1]
    with pytest.raises(ZeroDivisionError):
        next(broken)
    assert calls == [1, 1]
