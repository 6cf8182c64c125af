"""Sessions in blocks, exact medians, splits, overlaps and voices against plain rules; streams with timers and restarts."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from parlance.operators import sessions as N
from parlance.operators import splits as P
from parlance.operators import stats as A
from parlance.operators import transcripts as R
from parlance.operators import voice as V
from parlance.plans.queries_streams import finished
from parlance.streaming import jobs as J


def chunks(spark, seed, sizes):
    rng = random.Random(seed)
    rows = [(s, 3 * i, float(rng.randrange(12)), float(rng.randrange(12))) for s, n in enumerate(sizes) for i in range(n)]
    rows += [(None, i, float(rng.randrange(12)), 1.0) for i in range(30)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "session_id long, chunk_idx long, ch1 double, ch2 double").withColumn("value", F.col("ch1"))


def same(a, b, *columns):
    shown = lambda df: sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("session_id", "chunk_idx", *columns).collect()), key=repr)
    return shown(a) == shown(b)


@pytest.mark.parametrize("window,update", [(20, 5), (20, 7), (6, 9)])
def test_blocks_of_sessions_give_the_same_scores(spark, window, update):
    df = chunks(spark, window, [1, 17, 18, 200, 90])
    for block in (17, 64):
        assert same(N.rolling_zscore(df, window, update, block=block), N.rolling_zscore(df, window, update), "z")
        assert same(N.rolling_zscore_pooled(df, window, update, block=block), N.rolling_zscore_pooled(df, window, update), "z1", "z2")


def test_blocks_of_sessions_give_the_same_timers(spark):
    df = chunks(spark, 5, [1, 17, 18, 200, 90]).withColumn("z", F.when(F.col("ch1") == 4, None).otherwise(F.col("ch1") - 9)).withColumn("z1", F.col("z")).withColumn("z2", F.col("ch2") - 8)
    names = ("inactive_chunks", "inactive_secs", "activity_start_secs", "finalize")
    assert same(N.inactivity_timers(df, finalize=0.5, block=17), N.inactivity_timers(df, finalize=0.5), *names)
    names = ("ch1_inactive_secs", "ch2_inactive_secs", "activity_start_secs", "finalize")
    assert same(N.channel_timers(df, finalize=0.5, block=10), N.channel_timers(df, finalize=0.5), *names)
    _, long = N._long_sessions(df, ("session_id",), "chunk_idx", 17)
    assert {(r.session_id, r._b) for r in long.collect()} == {(2, 0), (2, 1), *((3, b) for b in range(12)), *((4, b) for b in range(6)), (None, 0), (None, 1)}


def test_pooled_scores_far_from_zero(spark):
    rng, values, want = random.Random(8), [], []
    mean, std = 0.0, 1.0
    for i in range(120):
        a, b = 1e8 + rng.randrange(4), 1e8 + rng.randrange(4)
        want.append((a - mean) / std if std else None)
        values.append((a, b))
        kept = [v for pair in values[-20:] for v in pair]
        n = min(len(values), 20)
        if n < 5 or n % 5 == 0:
            mean = sum(x - 1e8 for x in kept) / len(kept) + 1e8
            std = (sum((x - mean) ** 2 for x in kept) / len(kept)) ** 0.5 if n > 1 else 1.0
    df = spark.createDataFrame([(1, i, *v) for i, v in enumerate(values)], "session_id long, chunk_idx long, ch1 double, ch2 double")
    got = [r.z1 for r in N.rolling_zscore_pooled(df, 20, 5).orderBy("chunk_idx").collect()]
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-6 * max(1, abs(b))) for a, b in zip(got, want, strict=True))


def test_exact_medians(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.randrange(5)) if k != "ties" else 2.0) for k in ("a", "b", "ties") for _ in range({"a": 101, "b": 60, "ties": 8}[k])] + [("a", None), ("none", None), (None, 3.0), ("one", -1.5)]
    got = {r.stage: (r.median, r.n) for r in A.exact_median(spark.createDataFrame(rows, "stage string, factor double").repartition(5), "stage", "factor").collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: (statistics.median(v), len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 60, 1500])
def test_splits_equal_the_sorted_rule(spark, n):
    files = [f"c/f{i}" for i in range(n)] + ["d/only"]
    got = {r.file_id: r.split for r in P.file_split(spark.createDataFrame([(f, f[0]) for f in files], "file_id string, corpus_id string")).collect()}
    own = sorted(files[:-1], key=lambda f: (hashlib.md5(f"42:{f}".encode()).hexdigest(), f))
    train, dev = max(1, int(n * 0.94)), max(1, int(n * 0.02))
    assert got == {f: "train" if i < train else "dev" if i < train + dev else "test" for i, f in enumerate(own)} | {"d/only": "train"}


def plain_dedupe(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if kept:
            last = kept[-1]
            if last[2] == r[2] and last[4] == r[4] and r[3] > last[3]:
                kept[-1] = r
                continue
            if r[2] < last[3] or (last[3] == r[3] and last[4] == r[4] and r[2] > last[2]):
                continue
        kept.append(r)
    return kept


def test_overlaps_equal_the_plain_scan(spark):
    rng, rows = random.Random(12), []
    for f in range(25):
        at = 0.0
        for i in range(rng.randrange(1, 60)):
            at = max(0.0, at + rng.choice([-1.0, 0.0, 0.0, 0.5, 1.0, 4.0]))
            rows.append((f"f{f}", i, at, at + rng.choice([0.0, 0.5, 1.0, 1.0, 3.0]), rng.choice(["A", "B", None])))
    df = spark.createDataFrame([(*r, f"text {i}") for i, r in enumerate(rows)], "file_id string, line_idx int, start_secs double, end_secs double, speaker string, text string").repartition(6)
    got = R.dedupe_overlaps(df)
    assert got.columns == df.columns
    want = [r for f in {r[0] for r in rows} for r in plain_dedupe([r for r in rows if r[0] == f])]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_chosen_voices_equal_those_of_all_pairs(spark):
    rng = random.Random(21)
    turns = [(f"f{k % 4}", i, rng.choice("AB"), a := rng.randrange(9000), a + rng.choice([0, 20, 100, 200, 290, 400])) for k, i in enumerate(range(160))]
    alone = spark.createDataFrame([(*t, (t[4] - t[3]) / 50) for t in turns], "file_id string, line_no int, speaker string, start_code long, end_code long, length_secs double")
    wins = [(f"f{f}", s, k, a, a + w) for f in range(4) for s in "AB" for k, (a, w) in enumerate((a, w) for a in range(0, 9000, 700) for w in (0, 1000, 9000))]
    examples = spark.createDataFrame(wins, "file_id string, agent_speaker string, example_index int, win_start long, win_end long")
    shown = lambda df: sorted(map(tuple, df.select("file_id", "agent_speaker", "example_index", "line_no", "start_code", "end_code").collect()))
    for least in (20, 3, 1):
        want = shown(V.select_agent_voice(V.rank_voice_candidates(V.candidates_outside_window(alone, examples), least), 42))
        assert shown(V.choose_agent_voice(alone, examples, 42, least)) == want and len(want) > 100


SCORES = "session_id long, chunk_idx long, z1 double, z2 double, event_z double, probable_speaker string, at double"


def scored(spark, path, rows):
    df = spark.createDataFrame(rows, SCORES)
    df.select("session_id", "chunk_idx", "z1", "z2", "event_z", "probable_speaker", F.timestamp_millis((F.col("at") * 1000).cast("long")).alias("ts")).coalesce(1).write.mode("append").parquet(path)


def opened(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def shown(rows):
    return sorted(((r.session_id, r.chunk_idx, round(r.ch1_inactive_secs, 6), round(r.ch2_inactive_secs, 6), r.activity_start_secs, r.finalize, r.force_transcription, r.force_response) for r in rows), key=repr)


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_a_session_that_falls_silent_rings(spark, tmp_path, zone):
    """Session 1 stops after 1.2 s of silence on channel 1; its timer of 3 s goes off by session 2's events. Session 2 is over its timer already."""
    path = str(tmp_path / "in")
    spark.conf.set("spark.sql.session.timeZone", zone)
    scored(spark, path, [(1, i, 1.0 if i < 3 else -1.0, 1.0, 0.0, "user", 100 + i / 10) for i in range(15)])
    scored(spark, path, [(2, i, -1.0, -1.0, 2.0, "user", 100 + i / 10) for i in range(40)])
    scored(spark, path, [(2, 40, -1.0, -1.0, 2.0, "user", 120.0)])
    scored(spark, path, [(2, 41, 1.0, 1.0, 2.0, "user", 121.0), (3, 0, -1.0, -1.0, 0.0, "user", 121.0)])
    try:
        got = finished(J.stream_activity(opened(spark, path), late="0 seconds")).withColumn("at", F.unix_millis("at") / 1000).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    rung = [r for r in got if r.chunk_idx is None]
    assert [(r.session_id, r.at, r.ch1_inactive_secs, round(r.ch2_inactive_secs, 6), r.finalize, r.force_response) for r in rung] == [(1, 103.2, 3.0, 1.8, True, False)]
    two = sorted((r for r in got if r.session_id == 2), key=lambda r: r.chunk_idx)
    assert [r.finalize for r in two] == [i == 29 for i in range(42)] and [r.force_transcription for r in two] == [4 <= i < 41 for i in range(42)]
    assert [r.force_response for r in two] == [29 <= i < 41 for i in range(42)]


def test_sessions_are_forgotten_by_default_and_streams_restart(spark, tmp_path):
    """Batches before and after a restart from the checkpoint give the rows of one run; a session that was idle for over an hour starts anew."""
    rng, path = random.Random(2), str(tmp_path / "in")
    parts = [[(i % 3, p * 60 + i, float(rng.randrange(9)) - 4, float(rng.randrange(9)) - 4, float(rng.randrange(4)), rng.choice(["user", "agent"]), 1000 + p * 30 + i / 10) for i in range(60)] for p in range(4)]
    start = lambda out, make: make(opened(spark, path)).writeStream.format("parquet").option("path", f"{tmp_path}/{out}").option("checkpointLocation", f"{tmp_path}/{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    jobs = {"activity": lambda s: J.stream_activity(s, finalize=0.4, response_after=0.4), "scores": lambda s: J.stream_rolling_zscore(s.withColumn("value", F.col("z1")), 20, 5)}
    for rows in parts[:2]:
        scored(spark, path, rows)
    for name, make in jobs.items():
        start(f"{name}-twice", make)
    for rows in parts[2:]:
        scored(spark, path, rows)
    for name, make in jobs.items():
        start(f"{name}-twice", make)
        start(f"{name}-once", make)
        every = lambda out: sorted(map(repr, spark.read.parquet(f"{tmp_path}/{out}").filter("chunk_idx is not null").collect()))
        assert every(f"{name}-twice") == every(f"{name}-once") and len(every(f"{name}-once")) == 240
    scored(spark, path, [(0, 900, 5.0, 5.0, 0.0, "user", 9000.0)])
    scored(spark, path, [(1, 901, 5.0, 5.0, 0.0, "user", 20000.0)])
    scored(spark, path, [(0, 902, 7.0, 5.0, 0.0, "user", 20001.0)])
    start("scores-once", jobs["scores"])
    assert {r.chunk_idx: r.z for r in spark.read.parquet(f"{tmp_path}/scores-once").filter("chunk_idx >= 900").collect()}[902] == 7.0  # 0 and 1 are in force again
