"""Interleaving against a plain scan over the lines of a file, and the stateful rules."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import codes as K
from parlance.operators import interleave as I
from parlance.operators import sessions as N
from parlance.plans import examples as E
from parlance.schemas import CodecParams, Tokens

START, END = "<|audio|>", "<|end_audio|>"
CODEC = CodecParams(framerate=10.0)


def plain(lines, n, first, lo, hi):
    """The sequence of a view as a list of tokens, texts and (position of an audio code)."""
    out, last, who = [], lo, None
    for a, b, speaker, text in [*lines, (None, None, None, None)]:
        secs = b if first == "audio" else a
        at = hi if secs is None else int(secs * 10)
        if at > last:
            out += [START, *range(min(last, n), min(at, n)), END]
            last, who = at, None
        if speaker is not None:
            out.append(f" {text}" if speaker == who else f" {speaker}: {text}")
            who = speaker
    return out


def shown(seq):
    return "".join(x if isinstance(x, str) else chr(0xE000 + x) + chr(0xE000 + 1000 + x) for x in seq)


def transcripts(seed):
    rng, at, lines = random.Random(seed), 0.0, []
    for i in range(rng.randrange(1, 9)):
        at = max(0.0, at + rng.choice([-0.6, 0.0, 0.3, 1.0]))
        length = rng.choice([0.2, 0.7, 1.5])
        lines.append((round(at, 2), round(at + length, 2), rng.choice("AB"), f"t{i}"))
        at += length
    return sorted(lines)


def run(spark, cases, view, context=2.0, overlap=0.5, strides=16, parts=1):
    utt = [(f"f{k}", "c", i, a, b, s, t) for k, (lines, _) in cases.items() for i, (a, b, s, t) in enumerate(lines)]
    schema = "file_id string, corpus_id string, line_idx int, start_secs double, end_secs double, speaker string, text string"
    codes = [(f"f{k}", ch, f"p{p}", [ch * 1000 + i for i in range(n * p // parts, n * (p + 1) // parts)]) for k, (_, n) in cases.items() for ch in (0, 1) for p in range(parts)]
    rows = spark.createDataFrame(codes, "file_id string, channel int, part_ts string, codes array<int>")
    out = E.training_examples(spark.createDataFrame(utt, schema), rows, view, CODEC, Tokens(), context, overlap, 0.0, block_strides=strides)
    return {(r.file_id, r.agent_speaker, r.example_index): r.text.split("<|end_header|>")[1] for r in out.collect()}


@pytest.fixture(scope="module")
def cases():
    return {k: (transcripts(k), random.Random(k + 99).choice([30, 60, 200])) for k in range(12)}


@pytest.mark.parametrize("view,first", [("audio_first", "audio"), ("text_first", "text")])
def test_views_equal_a_plain_scan(spark, cases, view, first):
    got = run(spark, cases, view)
    for k, (lines, n) in cases.items():
        letters = {s: chr(65 + i) for i, s in enumerate(sorted({x[2] for x in lines}))}
        lo, hi = int(min(x[0] for x in lines) * 10), int(max(x[1] for x in lines) * 10)
        seq = plain([(a, b, letters[s], t) for a, b, s, t in lines], n, first, lo, hi)
        at = [i for i, x in enumerate(seq) if isinstance(x, int)]
        index, s = 0, 0
        while True:  # 20 frames a window, 5 of them shared
            e = s + 20
            part = seq[at[s] if s else 0 : at[e] if e < len(at) else len(seq)]
            assert got.pop((f"f{k}", None, index)) == shown(part), (k, index)
            if e >= len(at):
                break
            s, index = e - 5, index + 1
    assert not got


def test_agent_view_by_hand(spark):
    lines = [(0.0, 0.3, "A", "hi"), (0.2, 0.5, "B", "yes")]
    got = run(spark, {0: (lines, 10)}, "agent", 10.0, 5.0)
    c = lambda a, b: shown(range(a, b))
    # the last line is the other speaker's: both streams close, so its text stands between two end tokens
    assert got["f0", "A", 0] == f" A: hi{START}{c(0, 5)}{END} B: yes{END}"
    assert got["f0", "B", 0] == f"{START}{c(0, 2)}{END} A: yes{START}{c(2, 3)}{END} B: hi{START}{c(3, 5)}{END}"


def test_windows_cover_all_codes(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 19, 20, 21, 35, 36, 400)], "n long").select("n", I.audio_windows(F.col("n"), F.lit(20), F.lit(5)).alias("w")).collect()
    for r in rows:
        s, k = 0, 1
        while s + 20 < r.n:
            s, k = s + 15, k + 1
        assert r.w == k


def test_codes_beyond_the_basic_plane(spark):
    codes = [0, 5000, 131071]
    row = spark.createDataFrame([(codes,)], "c array<int>").select(K.codes_to_chars(F.col("c")).alias("s")).select("s", K.chars_to_codes(F.col("s")).alias("b")).first()
    assert row.s == "".join(chr(0xE000 + c) for c in codes) and row.b == codes
    empty = spark.createDataFrame([([],)], "c array<int>").select(K.codes_to_chars(F.col("c")).alias("s"), K.chars_to_codes(F.lit("")).alias("b")).first()
    assert empty.s == "" and empty.b == []
    ch = spark.createDataFrame([([[1, 2, 3], [4, 5]],)], "c array<array<int>>").select(K.interleave_channels(F.col("c")).alias("x"), K.frame_major(F.array(F.get("c", F.lit(1)), F.get("c", F.lit(1))), 100).alias("m")).first()
    assert ch.x == [1, 4, 2, 5] and ch.m == [4, 104, 5, 105]


@pytest.mark.parametrize("n", [1, 2, 49, 51, 120, 260])
def test_zscores_equal_the_running_rule(spark, n):
    rng = random.Random(n)
    values = [float(rng.randrange(10)) for _ in range(n)]
    kept, mean, std, want = [], 0.0, 1.0, []
    for v in values:
        want.append((v - mean) / std if std else None)
        kept = [*kept, v][-200:]
        if len(kept) < 50 or len(kept) % 50 == 0:
            mean = sum(kept) / len(kept)
            std = (sum((x - mean) ** 2 for x in kept) / len(kept)) ** 0.5 if len(kept) > 1 else 1.0
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "session_id long, chunk_idx long, value double")
    got = [r.z for r in N.rolling_zscore(df).orderBy("chunk_idx").collect()]
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got, want, strict=True))


def test_merge_turns_puts_in_silence(spark):
    rows = [("a", 0, "system", "s"), ("b", 0, "assistant", "x"), ("b", 1, "assistant", "y"), ("b", 2, "user", "z"), ("c", 0, "user", "u"), ("c", 1, "assistant", "v")]
    df = spark.createDataFrame(rows, "session_id string, turn_idx int, role string, text string")
    got = {}
    for r in N.merge_same_role_turns(df).orderBy("session_id", "msg_idx").collect():
        got.setdefault(r.session_id, []).append((r.role, r.content))
    quiet = ("user", "[silence]")
    assert got == {"a": [quiet], "b": [quiet, ("assistant", "x y"), ("user", "z")], "c": [("user", "u"), ("assistant", "v"), quiet]}


def test_streams_over_several_batches_equal_batch(spark, tmp_path):
    from parlance.plans.queries_streams import finished
    from parlance.streaming import jobs as J

    rng = random.Random(1)
    for part in range(3):
        rows = [(i % 4, part * 100 + i, float(rng.randrange(9))) for i in range(100)]
        spark.createDataFrame(rows, "session_id long, chunk_idx long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    a = {(r.session_id, r.chunk_idx): r.z for r in finished(J.stream_rolling_zscore(stream, 20, 5, None)).collect()}
    b = {(r.session_id, r.chunk_idx): r.z for r in N.rolling_zscore(batch, 20, 5).collect()}
    assert a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-9) for k in a)


def test_silent_sessions_are_forgotten(spark, tmp_path):
    from parlance.plans.queries_streams import finished
    from parlance.streaming import jobs as J

    # session 1 is silent from 5 to 100 s, while session 2 moves the watermark on
    for rows in ([(1, i, -1.0, i) for i in range(5)], [(2, i, -1.0, 50 + i) for i in range(5)], [(2, 5, -1.0, 60)], [(1, 5, -1.0, 100), (2, 6, -1.0, 61)]):
        df = spark.createDataFrame(rows, "session_id long, chunk_idx long, z double, at long")
        df.select("session_id", "chunk_idx", "z", F.timestamp_seconds(F.col("at") + 1000).alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session_id long, chunk_idx long, z double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for idle, want in (("20 seconds", 1), (None, 6)):
        got = {(r.session_id, r.chunk_idx): r.inactive_chunks for r in finished(J.stream_inactivity(stream, 0.1, 3.0, idle, "0 seconds")).collect()}
        assert got[1, 4] == 5 and got[1, 5] == want and got[2, 6] == 7


def test_turns_that_meet_over_long_files(spark):
    from parlance.operators import voice as V

    rng = random.Random(41)
    rows = [(f"f{k % 3}", i, rng.choice("ABC"), a := rng.randrange(20000), a + rng.choice([0, 1, 40, 3000])) for k, i in enumerate(range(300))]
    ranges = spark.createDataFrame(rows, "file_id string, line_no int, speaker string, start_code long, end_code long")
    sizes = spark.createDataFrame([("f0", 15000), ("f1", 30000), ("f2", 30000)], "file_id string, n_codes int")
    isolated = spark.createDataFrame([("f1", "A", True)], "file_id string, speaker string, isolated boolean")
    n = dict(sizes.collect())
    cut = lambda r: (min(r[3], n[r[0]]), min(r[4], n[r[0]]))
    meets = lambda x, y: x[0] == y[0] and x[2] != y[2] and cut(x)[0] < cut(x)[1] and cut(y)[0] < cut(y)[1] and cut(x)[0] < cut(y)[1] and cut(y)[0] < cut(x)[1]
    want = {x[1] for x in rows if (x[0], x[2]) == ("f1", "A") or not any(meets(x, y) for y in rows)}
    assert {r.line_no for r in V.non_overlapped_turns(ranges, sizes, isolated).collect()} == want


def test_blocks_of_codes_give_the_same_examples(spark, cases):
    for view in ("audio_first", "agent"):
        assert run(spark, cases, view, strides=1, parts=3) == run(spark, cases, view)
    parts = spark.createDataFrame([("f", c, p, list(range(n * 100, n * 100 + k))) for c in (0, 1) for n, (p, k) in enumerate([("a", 7), ("b", 0), ("c", 30)])], "file_id string, channel int, part_ts string, codes array<int>")
    whole = [*range(7), *range(200, 230)]
    got = {r.block: r.channels for r in I.code_blocks(parts, I.part_offsets(parts), 10, 5).collect()}
    assert got == {b: [whole[10 * b : 10 * b + 15]] * 2 for b in range(4)}


def test_a_long_recording_is_dealt_over_blocks(spark):
    """One file of two hours: its codes are rows of bounded size."""
    codec = CodecParams(framerate=50.0)
    parts = spark.range(2).selectExpr("'f' file_id", "cast(id as int) channel", "'p' part_ts", "transform(sequence(0, 359999), x -> cast(x as int)) codes")
    block, halo = I.block_sizes(codec, 80.0, 20.0, 6.0)
    rows = I.code_blocks(parts, I.part_offsets(parts), block, halo)
    sizes = rows.select(F.size(F.get("channels", F.lit(0))).alias("n"), F.size("channels").alias("c")).collect()
    assert len(sizes) == 8 and max(r.n for r in sizes) == block + halo == 52000 and {r.c for r in sizes} == {2}


def test_a_part_that_is_there_twice_is_an_error(spark):
    parts = spark.createDataFrame([("f", 0, "p", [1]), ("f", 0, "p", [2])], "file_id string, channel int, part_ts string, codes array<int>")
    with pytest.raises(Exception, match="a part is there twice"):
        I.part_offsets(parts).collect()


def test_mono_files_ignore_the_channel_map(spark):
    utt = [(f, "c", i, a, a + 1.0, s, f"t{i}") for f in ("mono", "stereo", "nocodes") for i, (a, s) in enumerate([(0.0, "A"), (1.0, "B"), (2.0, "A"), (9.0, "B")])]
    lines = spark.createDataFrame(utt, "file_id string, corpus_id string, line_idx int, start_secs double, end_secs double, speaker string, text string")
    parts = spark.createDataFrame([("mono", 0, "p", list(range(100))), *(("stereo", c, "p", [1000 * c + i for i in range(100)]) for c in (0, 1))], "file_id string, channel int, part_ts string, codes array<int>")
    swapped = spark.createDataFrame([(f, s, c, True) for f in ("mono", "stereo", "nocodes") for s, c in (("A", 1), ("B", 0))], "file_id string, speaker string, channel int, isolated boolean")
    made = lambda view, known: {(r.file_id, r.view, r.agent_speaker, r.example_index): r.text for r in E.training_examples(lines, parts, view, CODEC, Tokens(), 4.0, 1.0, 0.0, known).collect()}
    got, plain = made("all", swapped), made("all", None)
    assert set(got) == set(plain) and None not in got.values() and {k[0] for k in got} == {"mono", "stereo"}
    body = lambda t: t.split("<|end_header|>")[1]
    assert all(body(got[k]) == body(plain[k]) for k in got if k[0] == "mono")
    assert any(body(got[k]) != body(plain[k]) for k in got if k[0] == "stereo")
    voices = {k: t.split("<|agent_voice|>")[1].split("<|end_header|>")[0] for k, t in got.items() if "<|agent_voice|>" in t}
    assert {k[0] for k in voices} == {"mono", "stereo"} and all(ord(c) - 0xE000 < 100 for k, v in voices.items() for c in v if k[0] == "mono")
    assert {k[0] for k in made("text_only", swapped)} == {"mono", "stereo"}
    files = I.attach_transcripts(I.code_lengths(parts), lines, CODEC, channel_map=swapped)
    assert {r.file_id: r.channel_map for r in files.collect()} == {"mono": {}, "stereo": {"A": 1, "B": 0}}
    wrong = spark.createDataFrame([("stereo", "A", 2, True)], "file_id string, speaker string, channel int, isolated boolean")
    with pytest.raises(Exception, match="no channel 2 in stereo"):
        made("agent", wrong)


@pytest.mark.parametrize("context,overlap", [(7, 3), (5, 4), (40, 10)])
def test_text_windows_equal_the_rolling_rule(spark, context, overlap):
    rng, rows, want = random.Random(context), [], {}
    for k in range(30):
        text = [rng.choice(["A:", "B:", "C:", "x", "y", "z", "w"]) for _ in range(rng.randrange(1, 90))]
        rows.append((k, text, ["A", "B"]))
        start, i = 0, 0
        while True:
            end = start + context
            want[k, i] = (start, min(end, len(text)), " ".join(text[start:end]))
            if end >= len(text):
                break
            turns = [j for j in range(end - overlap, end) if text[j] in ("A:", "B:")]
            start, i = turns[0] if turns else end, i + 1
    df = spark.createDataFrame([*rows, (99, [], [])], "file_id long, words array<string>, speakers array<string>")
    got = {(r.file_id, r.example_index): (r.start_word, r.end_word, r.text) for r in I.text_windows(df, context, overlap).collect()}
    assert got == want | {(99, 0): (0, 0, "")}
