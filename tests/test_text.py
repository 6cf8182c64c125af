"""Text rules, one case for each."""

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.operators import transcripts as R
from parlance.sources import readers as S

CLEAN = [
    ("hello <comma> you <period> ok <questionmark> yes <exclamationpoint>", "hello, you. ok? yes!"),
    ("<sil> <music> <noise> <other>", "[sil] [music] [noise] [other]"),
    ("hello [!]", "hello!"),
    ("a [% note] b", "a [% note] b"),
    ("word \x1512_345\x15", "word"),
    ('+" quoted +, on +/. off', "quoted on off"),
    ("&-um well", "um well"),
    ("a°b☺c⁎d", "a b c d"),
    ("naïve – café* ", "naïve café"),
    ("ʔa", "a"),
    ("go &l=hums on &n=door", "go on"),
    ("x &=TSK y &=laughs", "x y &=laughs"),
    ("I ((maybe )) go", "I maybe go"),
    ("the u._s._a. and u_s_a", "the u.s.a. and u.s.a"),
    ("u_s and b_", "u.s and b."),
    ("a_bc", "a.bc"),
    ("ab_cd", "ab cd"),
    ("a   b", "a b"),
    ("a , b ; c 's", "a, b; c's"),
    ("do n't", "don't"),
    ("  a \t", "a"),
]


@pytest.mark.parametrize("line,want", CLEAN)
def test_clean_line(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(X.clean_line(F.col("l"))).first()[0] == want


def test_bracketed_go_on_request(spark):
    row = spark.createDataFrame([("a [= x] b [% y] c",)], "l string").select(X.clean_line(F.col("l")), X.clean_line(F.col("l"), remove_bracketed=True)).first()
    assert row[0] == "a [= x] b [% y] c" and row[1] == "a b [% y] c"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "l string").select(f(F.col("l"))).first()[0]


def test_asr_and_tts(spark):
    assert one(spark, "[ BLANK_AUDIO ] Mm-hmm, yes... >> ok.", X.clean_asr_text) == "mhm yes  ok"
    assert one(spark, "well (1.2) hhh so xx 0 [laughs] 0. &=coughs end", X.sanitize_for_tts) == "well ... so end"


def test_turns_and_markers(spark):
    turns = one(spark, "A: hi †there† B: yes A: ok", X.turns_of_sequence)
    assert [(t.speaker, t.text, t.text_with_external_markers) for t in turns] == [("A", "hi there", "hi †there†"), ("B", "yes", "yes"), ("A", "ok", "ok")]


def test_two_decimals_and_stamps(spark):
    row = spark.range(1).select(X.two_decimals(F.lit(12)), X.two_decimals(F.lit(-305)), X.format_timestamp(F.lit(3723.4565))).first()
    assert tuple(row) == ("0.12", "-3.05", "1:02:03.457")


def test_time_marks(spark):
    m = lambda a, b: f"\x15{a}_{b}\x15"
    rows = [("f", 0, f"one {m(0, 5)} two {m(5, 9)} lost", 0, 5), ("f", 1, "none", None, None), ("f", 2, f"single {m(9, 12)}", 9, 12)]
    df = spark.createDataFrame(rows, "file_id string, line_idx int, text string, mark_start_ms long, mark_end_ms long")
    got = [(r.line_idx, r.sub_idx, r.text, r.mark_start_ms) for r in R.expand_time_marks(df).orderBy("line_idx", "sub_idx").collect()]
    assert got == [(0, 0, f"one {m(0, 5)}", 0), (0, 1, f"two {m(5, 9)}", 5), (1, 0, "none", None), (2, 0, rows[2][2], 9)]
    with pytest.raises(Exception, match="time mark"):
        R.expand_time_marks(spark.createDataFrame([("f", 0, f"x {m(1, 2)}", 3, 4)], df.schema)).collect()


def test_chat_backfill(spark):
    rows = [(0, "A1", "hi", 0, 100), (1, "B1", "untimed", None, None), (2, "B1", "0 .", 100, 200), (3, "A1", "timed", 200, 300), (4, "B1", "trailing", None, None)]
    df = spark.createDataFrame([("f", *r, ["B1", "A1"]) for r in rows], "file_id string, line_idx int, speaker string, text string, mark_start_ms long, mark_end_ms long, participants array<string>")
    got = [(r.line_idx, r.speaker, r.start_secs) for r in R.clean_chat(df).orderBy("line_idx").collect()]
    assert got == [(0, "B", 0.0), (1, "A", 0.2), (3, "B", 0.2)]


def test_dedupe_against_the_last_kept(spark):
    rows = [(0, 0.0, 2.0, "A"), (1, 0.0, 3.0, "A"), (2, 1.0, 3.0, "A"), (3, 2.5, 4.0, "B"), (4, 3.0, 5.0, "B"), (5, 4.5, 6.0, "A"), (6, 5.0, 7.0, "A")]
    df = spark.createDataFrame([("f", *r) for r in rows], "file_id string, line_idx int, start_secs double, end_secs double, speaker string")
    assert sorted(r.line_idx for r in R.dedupe_overlaps(df).collect()) == [1, 4, 6]


def test_fisher_ranges(spark):
    rows = [("fe_03_p1_tran", n) for n in (0, 7, 8, 58)] + [("fe_03_p2_tran", n) for n in (58, 116)]
    got = [r.partition for r in R.fisher_partition(spark.createDataFrame(rows, "part string, num int")).orderBy("part", "num").collect()]
    assert got == ["fisher_eng_tr_sp_d1", "fisher_eng_tr_sp_d1", "fisher_eng_tr_sp_d2", "fisher_eng_tr_sp_d7", "fe_03_p2_sph1", "fe_03_p2_sph7"]
    with pytest.raises(Exception, match="no partition"):
        R.fisher_partition(spark.createDataFrame([("fe_03_p2_tran", 117)], "part string, num int")).collect()


def test_shares_and_letters(spark):
    rows = [("f", 0, 0.0, 8.0, "X", "a"), ("f", 1, 8.0, 8.5, "Y", "b"), ("f", 2, 9.0, 12.0, "Z", "c"), ("g", 0, 1.0, 1.0, "Q", "zero")]
    df = spark.createDataFrame(rows, "file_id string, line_idx int, start_secs double, end_secs double, speaker string, text string")
    got = [(r.file_id, r.speaker, r.line_no) for r in R.load_transcripts(df, 0.1).orderBy("file_id", "line_no").collect()]
    assert got == [("f", "A", 0), ("f", "B", 1), ("g", "A", 0)]


def test_transcript_lines(spark):
    df = spark.createDataFrame([("1.00 2.50 A: hello   there",), ("",), ("3.0 4.0 B:",)], "line string")
    assert [tuple(r)[1:] for r in S.transcript_lines(df).collect()] == [(1.0, 2.5, "A", "hello there")]
