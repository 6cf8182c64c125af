"""Bookkeeping of live sessions as windows over their chunks and turns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import format_timestamp, sentence_text
from ..session import staged
from .splits import numbered
from .stats import exact_median

#: Sessions of more rows are dealt over tasks by blocks of so many.
BLOCK = 1 << 20


def _long_sessions(df: DataFrame, keys: tuple[str, ...], order: str, block: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of sessions of `block` rows or fewer, and those of longer ones (None if there are none) with `_i`, their place in the
    session, and `_b`, the block of rows they are in. Long sessions are numbered by a sort over all of them, so that no task has one whole."""
    sizes = staged(df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > block), "long-sessions")
    if sizes.isEmpty():
        return df, None
    on = reduce(and_, (df[k].eqNullSafe(sizes[k]) for k in keys))
    rows = numbered(df.join(sizes, on, "left_semi"), *keys, order).drop("_total")
    firsts = rows.groupBy(*keys).agg(F.min("_place").alias("_first")).select(*(F.col(k).alias(f"_{k}") for k in keys), "_first")
    rows = rows.join(firsts, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))).withColumn("_i", F.col("_place") - F.col("_first"))
    return df.join(sizes, on, "left_anti"), rows.drop("_place", "_first", *(f"_{k}" for k in keys)).withColumn("_b", F.floor(F.col("_i") / block))


def _in_force(df: DataFrame, moments: Callable[[WindowSpec, Column], Column], window: int, update: int, keys: tuple[str, ...], order: str, block: int) -> DataFrame:
    """df with `_m` and `_s`, the mean and deviation in force before each row. moments(frame, size of the window) is their struct (m, s).

    Long sessions are cut into blocks of rows, each with the rows before it that its windows reach back to."""

    def windowed(rows: DataFrame, w: WindowSpec, n: Column) -> DataFrame:
        rows = rows.withColumn("_n", F.least(n, F.lit(window)))
        rows = rows.withColumn("_now", moments(w.rowsBetween(1 - window, 0), F.col("_n")))
        due = (F.col("_n") < update) | (F.col("_n") % update == 0)
        return rows.withColumn("_force", F.last(F.when(due, F.col("_now")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))

    short, long = _long_sessions(df, keys, order, block)
    w = Window.partitionBy(*keys).orderBy(order)
    out = windowed(short, w, F.row_number().over(w)).select(*df.columns, "_force")
    if long is not None:
        # a full window that isn't a multiple of `update` is never renewed: what its last due row gave stays in force
        last_due = window // update * update
        reach = window + update
        rows = long.withColumn("_k", F.explode(F.sequence(F.col("_b"), F.floor((F.col("_i") + reach) / block))))
        rows = windowed(rows, Window.partitionBy(*keys, "_k").orderBy("_i"), F.col("_i") + 1)
        own = rows.filter("_k = _b")
        if window > update and window % update:
            kept = own.filter(F.col("_i") == last_due - 1).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_now").alias("_kept"))
            own = own.join(kept, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left").withColumn("_force", F.when(F.col("_i") >= last_due, F.col("_kept")).otherwise(F.col("_force")))
        out = out.unionByName(own.select(*df.columns, "_force"))
    return out.select(*df.columns, F.coalesce("_force.m", F.lit(0.0)).alias("_m"), F.coalesce("_force.s", F.lit(1.0)).alias("_s"))


def rolling_zscore(df: DataFrame, window: int = 200, update: int = 50, value: str = "value", keys: tuple[str, ...] = ("session_id",), order: str = "chunk_idx", block: int = BLOCK) -> DataFrame:
    """z of each value by the mean and deviation in force before it, which are renewed on every value until there are
    `update`, then on every `update`-th size of the window; at first 0 and 1. A deviation of zero gives null. Sessions of more than `block` rows
    are dealt over tasks by blocks of rows."""
    moments = lambda frame, n: F.struct(F.avg(value).over(frame).alias("m"), F.when(n > 1, F.stddev_pop(value).over(frame)).otherwise(F.lit(1.0)).alias("s"))
    rows = _in_force(df, moments, window, update, keys, order, block)
    return rows.withColumn("z", F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def rolling_zscore_pooled(df: DataFrame, window: int = 200, update: int = 50, keys: tuple[str, ...] = ("session_id",), order: str = "chunk_idx", block: int = BLOCK) -> DataFrame:
    """z1 and z2 of two channels ch1, ch2 by their common mean and deviation, as rolling_zscore.

    The variance is that of the chunks' means and the mean of the variances within chunks, both by differences, so that large means don't cancel it."""
    middle, half = (F.col("ch1") + F.col("ch2")) / 2, (F.col("ch1") - F.col("ch2")) / 2

    def moments(frame: WindowSpec, n: Column) -> Column:
        deviation = F.sqrt(F.var_pop(middle).over(frame) + F.avg(half * half).over(frame))
        return F.struct(F.avg(middle).over(frame).alias("m"), F.when(n > 1, deviation).otherwise(F.lit(1.0)).alias("s"))

    rows = _in_force(df, moments, window, update, keys, order, block)
    return rows.withColumn("z1", F.try_divide(F.col("ch1") - F.col("_m"), F.col("_s"))).withColumn("z2", F.try_divide(F.col("ch2") - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def realtime_factor_blocks(df: DataFrame, chunk_secs: float = 0.1, block: int = 20, keys: tuple[str, ...] = ("session_id", "stage")) -> DataFrame:
    """(keys, block, factor): mean of chunk_secs / elapsed over each complete block of chunks."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_idx")) - 1
    rows = df.withColumn("block", F.floor(place / block)).withColumn("_f", F.lit(chunk_secs) / (F.col("elapsed_secs") + 1e-8))
    return rows.groupBy(*keys, "block").agg(F.avg("_f").alias("factor"), F.count("*").alias("_n")).filter(F.col("_n") == block).drop("_n")


def realtime_factor_summary(blocks: DataFrame) -> DataFrame:
    """(stage, median_factor, blocks). Factors are counted and sorted by range for their median: no task has a stage whole."""
    return exact_median(blocks, "stage", "factor").select("stage", F.col("median").alias("median_factor"), F.col("n").alias("blocks"))


def inactivity_timers(df: DataFrame, z: str = "z", chunk_secs: float = 0.1, finalize: float = 3.0, keys: tuple[str, ...] = ("session_id",), order: str = "chunk_idx", block: int = BLOCK) -> DataFrame:
    """inactive_secs since the last z >= 0 (or the start), activity_start_secs of the latest rise of z from below 0, and whether this chunk crosses `finalize`.

    Sessions of more than `block` rows are dealt over tasks by blocks; a block starts with what the ones before it carry over."""

    def timed(rows: DataFrame, i: Column, last: Column, rise: Column) -> DataFrame:
        since = i - F.coalesce(last, F.lit(0))
        rows = rows.withColumn("inactive_chunks", since).withColumn("inactive_secs", since * chunk_secs)
        rows = rows.withColumn("activity_start_secs", (rise - 1) * chunk_secs)
        crossed = (F.col("inactive_secs") >= finalize) & ((F.col("inactive_chunks") - 1) * chunk_secs < finalize)
        return rows.withColumn("finalize", crossed).select(*df.columns, "inactive_chunks", "inactive_secs", "activity_start_secs", "finalize")

    def marked(rows: DataFrame, w: WindowSpec, before: Column) -> DataFrame:
        active = F.coalesce(F.col(z) >= 0, F.lit(False))
        rose = active & (F.coalesce(F.when(F.row_number().over(w) == 1, before).otherwise(F.lag(z).over(w)), F.lit(0.0)) < 0)
        return rows.withColumn("_on", F.when(active, F.col("_at"))).withColumn("_up", F.when(rose, F.col("_at")))

    short, long = _long_sessions(df, keys, order, block)
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = marked(short.withColumn("_at", F.row_number().over(w)), w, F.lit(None).cast("double"))
    out = timed(rows, F.col("_at"), F.max("_on").over(upto), F.max("_up").over(upto))
    if long is None:
        return out
    long = long.withColumn("_at", F.col("_i") + 1)
    own = ["_b", *keys]
    ends = long.groupBy(*own).agg(F.max_by(F.struct(F.col(z).alias("z")), "_i").alias("_end"))
    blocks = Window.partitionBy(*keys).orderBy("_b")
    same = lambda a, b: reduce(and_, (a[k].eqNullSafe(b[k]) for k in own))
    with_end = lambda left, right, *more: left.join(right, same(left, right), "left").select(*(left[c] for c in left.columns), *more)
    ends = staged(ends.select(*own, F.lag("_end").over(blocks)["z"].alias("_before")), "blocks")
    inside = Window.partitionBy(*keys, "_b").orderBy("_i")
    rows = marked(with_end(long, ends, "_before"), inside, F.col("_before"))
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*own).agg(F.max("_on").alias("_on"), F.max("_up").alias("_up"))
    carried = staged(carried.select(*own, F.max("_on").over(earlier).alias("_last"), F.max("_up").over(earlier).alias("_rise")), "carried")
    rows = with_end(rows, carried, "_last", "_rise")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return out.unionByName(timed(rows, F.col("_at"), F.coalesce(F.max("_on").over(upto), "_last"), F.coalesce(F.max("_up").over(upto), "_rise")))


def channel_timers(df: DataFrame, chunk_secs: float = 0.1, finalize: float = 3.0, keys: tuple[str, ...] = ("session_id",), order: str = "chunk_idx", block: int = BLOCK) -> DataFrame:
    """df with ch1_inactive_secs and ch2_inactive_secs by z1 and z2, the second channel's activity_start_secs, and whether the first one crosses `finalize`."""
    first = inactivity_timers(df, "z1", chunk_secs, finalize, keys, order, block).withColumnRenamed("inactive_secs", "ch1_inactive_secs").drop("inactive_chunks", "activity_start_secs")
    second = inactivity_timers(first.withColumnRenamed("finalize", "_crosses"), "z2", chunk_secs, finalize, keys, order, block)
    return second.drop("finalize", "inactive_chunks").withColumnRenamed("inactive_secs", "ch2_inactive_secs").withColumnRenamed("_crosses", "finalize")


def force_flags(df: DataFrame, trans_after: float = 0.5, response_after: float = 3.0) -> DataFrame:
    """force_transcription and force_response from ch1/ch2_inactive_secs, event_z and probable_speaker; 0 switches one off."""
    trans = (F.col("ch2_inactive_secs") >= trans_after) & (F.col("event_z") >= 1.0) & (F.col("probable_speaker") == "user")
    response = F.least("ch1_inactive_secs", "ch2_inactive_secs") >= response_after
    on = lambda c, after: F.coalesce(c, F.lit(False)) if after else F.lit(False)
    return df.withColumn("force_transcription", on(trans, trans_after)).withColumn("force_response", on(response, response_after))


def merge_same_role_turns(df: DataFrame, prefill: bool = False, key: str = "session_id") -> DataFrame:
    """(key, msg_idx, role, content): runs of one role joined by a space. A user turn "[silence]" is put in if the assistant
    speaks first, if nothing follows the system turn, or (without prefill) if the assistant is last. Rows: key, turn_idx, role, text."""
    w = Window.partitionBy(key).orderBy("turn_idx")
    talk = df.filter(F.col("role") != "system")
    rows = talk.withColumn("_new", (F.coalesce(F.lag("role").over(w), F.lit("")) != F.col("role")).cast("int")).withColumn("_run", F.sum("_new").over(w))
    runs = rows.groupBy(key, "_run", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", "text"))), lambda x: x["text"]), " ").alias("content"))
    ends = talk.groupBy(key).agg(F.min_by("role", "turn_idx").alias("_first"), F.max_by("role", "turn_idx").alias("_last"))
    every = df.select(key).distinct().join(ends, key, "left")
    silence = lambda place, when: every.filter(when).select(key, F.lit(place).alias("_run"), F.lit("user").alias("role"), F.lit("[silence]").alias("content"))
    added = silence(0, F.col("_first") == "assistant").unionByName(silence(2147483647, F.col("_last").isNull() | ((F.col("_last") == "assistant") & F.lit(not prefill))))
    out = runs.select(key, F.col("_run").cast("int").alias("_run"), "role", "content").unionByName(added)
    return out.withColumn("msg_idx", F.row_number().over(Window.partitionBy(key).orderBy("_run"))).drop("_run")


def chat_messages_json(messages: DataFrame, system: str, key: str = "session_id") -> DataFrame:
    """(key, messages): a JSON array of the system prompt and the merged messages."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return messages.groupBy(key).agg(F.to_json(F.concat(first, ordered)).alias("messages"))


def last_turn_by_role(df: DataFrame, agent: Column, key: str = "session_id") -> DataFrame:
    """(key, is_agent, turn_idx, text) of the latest agent turn and the latest other turn."""
    return df.groupBy(key, agent.alias("is_agent")).agg(F.max("turn_idx").alias("turn_idx"), F.max_by("text", "turn_idx").alias("text"))


def assemble_sentences(df: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, sentence_idx, sentence): chunks of text up to one that ends in . ! ? : or ;"""
    w = Window.partitionBy(key).orderBy("chunk_idx")
    ends = F.col("text").rlike(r"[.!?:;]\z").cast("int")
    rows = df.withColumn("sentence_idx", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda x: x["text"]), "")
    return rows.groupBy(key, "sentence_idx").agg(sentence_text(joined).alias("sentence")).filter(F.length("sentence") > 0)


def turn_times(df: DataFrame, key: str = "session_id") -> DataFrame:
    """start_secs and end_secs of turns that came up at now_secs: an agent's turn starts now and is open; another's starts
    at its activity (activity_start_secs, null for none), the end of the last such turn at least, and ends now."""
    w = Window.partitionBy(key, "is_agent").orderBy("turn_idx")
    before = F.coalesce(F.lag("now_secs").over(w), F.lit(0.0))
    start = F.when(F.col("is_agent"), F.col("now_secs")).otherwise(F.greatest(F.coalesce("activity_start_secs", before), before))
    return df.withColumn("start_secs", start).withColumn("end_secs", F.when(~F.col("is_agent"), F.col("now_secs")))


def truncate_improbable_run(df: DataFrame, tolerance: int = 3, key: str = "turn_id") -> DataFrame:
    """(key, kept, text): tokens (token_idx, token, ratio) before the first run of more than `tolerance` ratios below 1; "[silence]" if none is left."""
    w = Window.partitionBy(key).orderBy("token_idx")
    rows = df.withColumn("_run", F.sum((F.col("ratio") >= 1).cast("int")).over(w)).withColumn("_low", (F.col("ratio") < 1).cast("int"))
    run = Window.partitionBy(key, "_run").orderBy("token_idx")
    rows = rows.withColumn("_k", F.sum("_low").over(run)).withColumn("_start", F.min(F.when(F.col("_low") == 1, F.col("token_idx"))).over(Window.partitionBy(key, "_run")))
    cut = F.min(F.when(F.col("_k") > tolerance, F.col("_start"))).over(Window.partitionBy(key))
    rows = rows.withColumn("_cut", cut).withColumn("_in", F.col("_cut").isNull() | (F.col("token_idx") < F.col("_cut")))
    kept = F.array_sort(F.collect_list(F.when(F.col("_in"), F.struct("token_idx", "token"))))
    out = rows.groupBy(key).agg(kept.alias("_t"))
    text = F.regexp_replace(F.array_join(F.transform("_t", lambda t: t["token"]), ""), r"(?U)^\s+", "")
    return out.select(key, F.size("_t").alias("kept"), F.when(F.size("_t") == 0, "[silence]").otherwise(text).alias("text"))


def probable_event_speaker(z: Column, agent_p: Column, user_p: Column) -> Column:
    """Who is about to speak: null while z is below 0."""
    return F.when(z >= 0, F.when(agent_p > user_p, "agent").otherwise("user"))


def interrupt_or_substitute(z: Column, has_external: Column) -> Column:
    """own (no external codes), interrupted (z of the score is 1 or more: own codes stay) or external."""
    return F.when(~has_external, "own").when(z >= 1.0, "interrupted").otherwise("external")


def trim_context(total: Column, most: int = 80, by: int = 20) -> Column:
    """Where the context starts: it moves by `by` seconds as soon as `most` have gone by since."""
    return by * F.greatest(F.lit(0), F.floor((total - most) / by) + 1)


def format_transcript(df: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, transcript): a line for each turn; a turn that was cut shows the rest of what was planned. Rows have total_secs."""
    planned = F.when(F.col("text") == "[silence]", F.col("planned_text")).otherwise(F.regexp_replace(F.expr("substring(planned_text, length(text) + 1)"), r"(?U)^\s+", ""))
    cut = F.col("planned_text").isNotNull() & (F.col("planned_text") != F.col("text"))
    said = F.when(cut, F.concat("text", F.lit("  ⟶  {"), planned, F.lit("}"))).otherwise(F.col("text_with_external_markers"))
    line = F.concat(F.lit("["), format_timestamp(F.col("start_secs")), F.lit(" - "), format_timestamp(F.coalesce("end_secs", "total_secs")), F.lit("] "), "speaker", F.lit(": "), said)
    rows = df.select(key, "start_secs", "turn_idx", line.alias("line"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_secs", "turn_idx", "line"))), lambda x: x["line"]), "\n").alias("transcript"))
