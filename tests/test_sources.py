"""Files written and read back, and statistics of lengths."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import channels as C
from parlance.operators import splits as P
from parlance.operators.stats import dataset_stats
from parlance.sources import readers as S
from parlance.sources import writers as W


def test_codes_from_array_files(spark, tmp_path):
    (tmp_path / "corp").mkdir()
    np.save(tmp_path / "corp" / "call_c0_p1.npy", np.array([[5, 6]]))
    np.save(tmp_path / "corp" / "call_c0_p0.npy", np.array([[[1, 2, 3]]], np.int32))
    np.save(tmp_path / "corp" / "call_c1.npy", np.asfortranarray(np.array([[7, 8], [9, 9]], np.int16)))
    rows = {(r.file_id, r.channel, r.part_ts): r.codes for r in S.read_codes(spark, str(tmp_path)).collect()}
    assert rows == {("corp/call", 0, "p0"): [1, 2, 3], ("corp/call", 0, "p1"): [5, 6], ("corp/call", 1, ""): [7, 8]}
    both = S.read_codes(spark, str(tmp_path), include=("call_c1",), num_codebooks=2, size=100).first()
    assert both.codes == [7, 109, 8, 109]
    np.save(tmp_path / "nochannel.npy", np.array([1]))
    with pytest.raises(Exception, match="no channel"):
        S.read_codes(spark, str(tmp_path)).collect()


def test_list_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.wav").write_bytes(b"123")
    (tmp_path / "a" / "y.txt").write_text("t")
    r = S.list_files(spark, str(tmp_path), ".wav").collect()
    assert [(x.file_id, x.folder, x.corpus_id, x.length) for x in r] == [("a/b/x", "a/b", "a", 3)]


def test_chat_files(spark, tmp_path):
    (tmp_path / "t.cha").write_text("@Begin\n@Participants:\tPA1 Ann Adult, PA2 Bob Adult\n*PA1:\thello there \x1510_20\x15\n*PA2:\tgoes\n\ton \x1520_30\x15\n%com:\tno\n@End\n")
    r = S.read_chat_utterances(spark, str(tmp_path)).orderBy("line_idx").collect()
    assert [(x.speaker, x.mark_start_ms, x.mark_end_ms) for x in r] == [("PA1", 10, 20), ("PA2", 20, 30)]
    assert r[0].participants == ["PA1", "PA2"] and r[1].text.startswith("goes on")


def test_gigaspeech_and_libriheavy_files(spark, tmp_path):
    seg = lambda s, t: {"speaker": s, "text_tn": t, "begin_time": 1.0, "end_time": 2.0}
    doc = {"audios": [{"path": "x/podcast/P0000/a", "segments": [seg("s2", "HELLO <COMMA> you"), seg("s1", "<SIL>")]}, {"path": "x/podcast/P0001/b", "segments": [seg("s", "no")]}, {"path": "y/youtube/P0039/c", "segments": [seg("s", "Yes")]}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    r = {(x.file_id, x.line_idx): (x.speaker, x.text) for x in S.read_gigaspeech(spark, str(tmp_path / "g.json")).collect()}
    assert r == {("x/podcast/P0000/a", 0): ("A", "hello, you"), ("x/podcast/P0000/a", 1): ("B", "[sil]"), ("y/youtube/P0039/c", 0): ("A", "yes")}
    cut = {"start": 10.0, "recording": {"id": "r"}, "supervisions": [{"speaker": "x", "start": 1.0, "duration": 2.0, "custom": {"texts": ["Hi there", "raw"]}}]}
    (tmp_path / "l.jsonl").write_text(json.dumps(cut) + "\n")
    x = S.read_libriheavy(spark, [str(tmp_path / "l.jsonl")]).first()
    assert (x.recording, x.start_secs, x.end_secs, x.speaker, x.text) == ("r", 11.0, 13.0, "A", "Hi there")


def test_transcripts_and_channel_maps(spark, tmp_path):
    lines = spark.createDataFrame([("c/f", "c", 0, 1.005, 2.0, "A", "hi"), ("c/f", "c", 1, 2.0, 3.25, "B", "yes")], "file_id string, corpus_id string, line_idx int, start_secs double, end_secs double, speaker string, text string")
    W.write_transcripts(lines, f"{tmp_path}/out")
    text = [r.line for r in spark.read.parquet(f"{tmp_path}/out").orderBy("line_idx").collect()]
    assert text[1] == "2.00 3.25 B: yes"
    (tmp_path / "tr" / "c").mkdir(parents=True)
    (tmp_path / "tr" / "c" / "f.txt").write_text("\n".join(text) + "\n\n")
    (tmp_path / "tr" / "c" / "f_channel_map.json").write_text('{"A": {"channel": 0, "duration_secs": 1.5}, "B": {"channel": null, "duration_secs": 0.0}}')
    assert [(r.file_id, r.line_idx, r.speaker) for r in S.read_transcripts(spark, f"{tmp_path}/tr").orderBy("line_idx").collect()] == [("c/f", 0, "A"), ("c/f", 1, "B")]
    m = S.read_channel_map(spark, f"{tmp_path}/tr")
    assert sorted((r.file_id, r.speaker, r.channel) for r in m.collect()) == [("c/f", "A", 0), ("c/f", "B", None)]
    W.write_channel_map(m, f"{tmp_path}/maps")
    W.write_channel_map(m.union(spark.createDataFrame([("g", "A", 1, 2.0)], m.schema)), f"{tmp_path}/maps")
    back = C.parse_channel_map(spark.read.parquet(f"{tmp_path}/maps"))
    assert sorted(r.file_id for r in back.collect()) == ["c/f", "c/f", "g"]


def test_examples_splits_and_training_text(spark, tmp_path):
    ex = spark.createDataFrame([(f"c{i % 2}/f{i}", 0, f"text {i}") for i in range(60)], "file_id string, example_index int, text string")
    splits = P.file_split(P.corpus_files(ex))
    W.write_splits(ex, splits, f"{tmp_path}/s")
    back = S.read_file_splits(spark, f"{tmp_path}/s/file_splits")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in splits.collect()}
    n = {r.split: r["count"] for r in spark.read.parquet(f"{tmp_path}/s/examples").groupBy("split").count().collect()}
    assert n == {"train": 56, "dev": 2, "test": 2}
    for kind in ("parquet", "json", "text"):
        W.write_examples(ex, f"{tmp_path}/{kind}", kind)
    assert S.read_training_text(spark, f"{tmp_path}/json").count() == 60 if f"{tmp_path}/json".endswith(".json") else True
    (tmp_path / "t.csv").write_text("a,b\nx,y\n")
    (tmp_path / "t.txt").write_text("l1\nl2\n")
    assert S.read_training_text(spark, str(tmp_path / "t.csv")).first().text == "x"
    assert [r.text for r in S.read_training_text(spark, str(tmp_path / "t.txt")).collect()] == ["l1\n", "l2\n"]
    with pytest.raises(ValueError):
        S.read_training_text(spark, str(tmp_path / "t.bin"))
    with pytest.raises(Exception, match="no split"):
        P.assign_split(ex, splits.filter("split = 'dev'")).collect()


@pytest.mark.parametrize("n,want", [(1, (1, 0, 0)), (2, (1, 1, 0)), (3, (2, 1, 0)), (50, (47, 1, 2))])
def test_split_sizes(spark, n, want):
    files = spark.createDataFrame([(f"c/{i}", "c") for i in range(n)], "file_id string, corpus_id string")
    got = {r.split: r["count"] for r in P.file_split(files).groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "dev", "test")) == want
    with pytest.raises(ValueError):
        P.file_split(files, train=0.5)


def test_head_validation_is_exact(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    out = P.head_validation(df, 5, "k")
    assert sorted(r.k for r in out.filter("is_validation").collect()) == list(range(50))


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0], [None, 5.0, 1.0, 9.0], [80.0] * 700 + [float(i % 97) / 4 for i in range(1300)]])
def test_dataset_stats_equal_numpy(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "seconds double").repartition(7)
    r = dataset_stats(rows).collect()[0]
    own = [v for v in values if v is not None]
    assert r["n"] == len(values)
    want = [sum(own), sum(own) / 3600, max(own), min(own), np.median(own), np.mean(own), np.std(own)] if own else [None] * 7
    assert list(r)[1:] == (pytest.approx(want) if own else want)
