"""Queries against their SQL on conversations that the given tables don't have."""

import duckdb
import pytest

import __spark_entry__ as entry

#: Conversations whose audio begins with code 7935 in a view: its character is U+FEFF, the byte order mark.
MARKED = [57896, 65777, 327921, 1376497]


@pytest.fixture(scope="module")
def marked(tmp_path_factory):
    path = tmp_path_factory.mktemp("marked")
    duckdb.sql(
        f"""copy (select c as conv_id, t as turn, case when t % 2 = 0 then 'user' else 'assistant' end as role, array_to_string(list_transform(range(0, 60 + t * 7), lambda i: 'w' || i), ' ') as text
        from (select unnest({MARKED})::bigint as c), (select unnest(range(0, 4)) as t)) to '{path}/conversations.parquet' (format parquet)"""
    )
    return path


def both(spark, path, name):
    """Rows of the query and of its SQL."""
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{path}/conversations.parquet'")
    df = entry.queries()[name](spark, str(path))
    cols = sorted(df.columns)
    want = c.execute(f"select {', '.join(f'"{x}"' for x in cols)} from ({entry.oracle_sql()[name]})").fetchall()
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr), sorted(want, key=repr)


@pytest.mark.parametrize("name", ["f5_codes_to_chars", "f11_agent_prompt", "f12_strip_non_audio", "f13_shorten_codes", "f23_example_seconds", "a4_dataset_stats", "x9_audio_first_examples", "x9_text_first_examples", "x9_mono_and_stereo_examples"])
def test_a_first_code_that_looks_like_a_byte_order_mark_stays(spark, marked, name):
    got, want = both(spark, marked, name)
    assert got == want and got


#: Conversations (number, words of their turns) whose first speaker has a tenth of the file's words: as a sum of doubles the share is a tenth or a
#: little less, by the order of the total.
TIED = {27041: [6, 14, 40], 35131: [30, 42, 175, 53], 36799: [44, 5, 220, 28, 130, 13], 42241: [42, 37, 176, 48, 82, 35], 44166: [42, 42, 151, 20, 150, 15], 62109: [47, 57, 94, 4, 180, 52, 28, 8]}


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tied")
    role = lambda turn: "system" if turn == 0 else "user" if turn % 2 else "assistant"
    rows = [(conv, turn, role(turn), " ".join(["w"] * n)) for conv, sizes in TIED.items() for turn, n in enumerate(sizes)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", ["a7_channel_isolated", "j5_attach_channel_map", "o6_audio_stretch_events", "x9_text_only_examples", "s8_channel_map_kept"])
def test_a_share_at_the_threshold_does_not_depend_on_partitions(spark, tied, name):
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 16, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted((tuple(r) for r in entry.queries()[name](spark, str(tied)).collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] and found[0] == found[1] == found[2]
