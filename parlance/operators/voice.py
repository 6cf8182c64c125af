"""Voice samples of the agent: turns that no one else talks over, outside the example, one chosen by a hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CodecParams

#: Turns are compared within stretches of so many codes.
STRETCH = 1500
#: Samples last so long at most.
LONGEST_SECS = 6.0


def speech_ranges(lines: DataFrame, codec: CodecParams) -> DataFrame:
    """Lines with their range of codes: start_code, end_code, length_secs."""
    at = lambda c: (F.col(c) * F.lit(codec.framerate) * F.lit(codec.num_codebooks)).cast("bigint")
    return lines.withColumn("start_code", at("start_secs")).withColumn("end_code", at("end_secs")).withColumn("length_secs", F.col("end_secs") - F.col("start_secs"))


def non_overlapped_turns(ranges: DataFrame, n_codes: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """Turns whose codes no other speaker's turn of the file shares; ends are cut to the audio, empty ranges overlap nothing.

    isolated: (file_id, speaker, isolated); turns of a speaker whose channel is isolated all stay. Turns meet by stretches of the
    file that both are in, so a file of any length is no quadratic work.
    """
    rows = ranges.join(n_codes.select("file_id", "n_codes"), "file_id").withColumn("_a", F.least("start_code", "n_codes")).withColumn("_b", F.least("end_code", "n_codes"))
    if isolated is None:
        rows = rows.withColumn("_alone", F.lit(False))
    else:
        rows = rows.join(isolated.select("file_id", "speaker", F.col("isolated").alias("_alone")), ["file_id", "speaker"], "left").withColumn("_alone", F.coalesce("_alone", F.lit(False)))
    rows = rows.withColumn("_at", F.explode_outer(F.when(F.col("_a") < F.col("_b"), F.sequence((F.col("_a") / STRETCH).cast("bigint"), ((F.col("_b") - 1) / STRETCH).cast("bigint")))))
    other = rows.select(F.col("file_id").alias("_f"), F.col("_at").alias("_o"), F.col("speaker").alias("_s"), F.col("_a").alias("_oa"), F.col("_b").alias("_ob"))
    meets = (F.col("file_id") == F.col("_f")) & (F.col("_at") == F.col("_o")) & (F.col("speaker") != F.col("_s")) & (F.col("_a") < F.col("_ob")) & (F.col("_oa") < F.col("_b")) & ~F.col("_alone")
    met = rows.join(other, meets, "left_semi").select("file_id", "line_no").distinct()
    return ranges.join(n_codes.select("file_id"), "file_id", "left_semi").join(met, ["file_id", "line_no"], "left_anti")


def candidates_outside_window(candidates: DataFrame, examples: DataFrame, max_secs: float = LONGEST_SECS) -> DataFrame:
    """Candidates of the agent for each example (file_id, agent_speaker, example_index, win_start, win_end in codes of a channel) that lie outside of its window."""
    rows = examples.join(candidates.filter(F.col("length_secs") <= max_secs).withColumnRenamed("speaker", "agent_speaker"), ["file_id", "agent_speaker"])
    return rows.filter((F.col("end_code") <= F.col("win_start")) | (F.col("start_code") >= F.col("win_end")))


def rank_voice_candidates(rows: DataFrame, least: int = 20, long_secs: float = 3.0) -> DataFrame:
    """voice_rank by length, then line; kept are the `least` longest and all of long_secs or more."""
    order = Window.partitionBy("file_id", "agent_speaker", "example_index").orderBy(F.desc("length_secs"), "line_no")
    ranked = rows.withColumn("voice_rank", F.row_number().over(order) - 1)
    return ranked.filter((F.col("voice_rank") < least) | (F.col("length_secs") >= long_secs))


def select_agent_voice(ranked: DataFrame, seed: int = 42) -> DataFrame:
    """One candidate of each example: the rank that an MD5 of seed, file, agent and index gives, modulo their number.

    The same on every cluster and run, which a shared random generator isn't.
    """
    group = Window.partitionBy("file_id", "agent_speaker", "example_index")
    digest = F.md5(F.concat_ws(":", F.lit(seed), "file_id", "agent_speaker", "example_index"))
    pick = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.count("*").over(group)
    return ranked.withColumn("_pick", pick).withColumn("_i", F.row_number().over(group.orderBy("voice_rank")) - 1).filter("_i = _pick").drop("_pick", "_i")


def choose_agent_voice(candidates: DataFrame, examples: DataFrame, seed: int = 42, least: int = 20, long_secs: float = 3.0, max_secs: float = LONGEST_SECS) -> DataFrame:
    """What select_agent_voice chooses from rank_voice_candidates of candidates_outside_window, without a row for each window and candidate.

    A speaker's candidates are ranked once. A window only leaves out the few that lie in it, so their ranks and the counts of all give
    the place of the chosen one among all: the work grows with windows and turns. Windows and turns meet by stretches of the file.
    """
    own = ["file_id", "agent_speaker"]
    fits = candidates.filter(F.col("length_secs") <= max_secs).withColumnRenamed("speaker", "agent_speaker")
    ranked = fits.withColumn("_rank", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("length_secs"), "line_no")) - 1)
    long = F.col("length_secs") >= long_secs
    totals = ranked.groupBy(*own).agg(F.count("*").alias("_all"), F.sum(long.cast("bigint")).alias("_long"))
    stretches = lambda a, b: F.sequence(F.floor(F.col(a) / STRETCH), F.floor(F.col(b) / STRETCH))
    wins = examples.withColumn("_at", F.explode(stretches("win_start", "win_end")))
    turns = ranked.select(*own, "start_code", "end_code", "_rank", long.alias("_is_long")).withColumn("_at", F.explode(stretches("start_code", "end_code")))
    inside = (F.col("end_code") > F.col("win_start")) & (F.col("start_code") < F.col("win_end"))
    once = F.col("_at") == F.greatest(F.floor(F.col("win_start") / STRETCH), F.floor(F.col("start_code") / STRETCH))
    out = wins.join(turns, [*own, "_at"]).filter(inside & once)
    lost = out.groupBy(*own, "example_index").agg(F.array_sort(F.collect_list("_rank")).alias("_ranks"), F.sum(F.col("_is_long").cast("bigint")).alias("_lost_long"))
    rows = examples.join(totals, own).join(lost, [*own, "example_index"], "left")
    ranks = F.coalesce("_ranks", F.array().cast("array<int>"))
    left = F.col("_all") - F.size(ranks)
    rows = rows.withColumn("_n", F.greatest(F.least(F.lit(least), left), F.col("_long") - F.coalesce("_lost_long", F.lit(0)))).filter("_n > 0")
    digest = F.md5(F.concat_ws(":", F.lit(seed), "file_id", "agent_speaker", "example_index"))
    pick = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.col("_n")
    # ranks that the window leaves out move the chosen one back, as far as they lie before it
    moved = F.aggregate(ranks, pick, lambda at, r: at + (r <= at).cast("bigint"))
    chosen = rows.select(*own, "example_index", moved.cast("int").alias("_rank"))
    return chosen.join(ranked, [*own, "_rank"]).drop("_rank")
