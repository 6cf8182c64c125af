"""Streams over session events: the same rules as the batch operators, kept as keyed state or windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import clean_asr_text, clean_line, sanitize_for_tts, turns_of_sequence

ZSCORES = "session_id long, chunk_idx long, value double, z double"
ACTIVITY = "session_id long, chunk_idx long, at timestamp, ch1_inactive_secs double, ch2_inactive_secs double, activity_start_secs double, finalize boolean, force_transcription boolean, force_response boolean"
TIMERS = "session_id long, chunk_idx long, z double, inactive_chunks long, finalize boolean"
#: A session without events for so long, by event time, is forgotten.
IDLE = "1 hour"
#: Moments of a session are taken of so many windows at once.
WINDOWS = 4096


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(batches).sort_values("chunk_idx", kind="stable")


def _ms(interval: str) -> int:
    return pd.Timedelta(interval) // pd.Timedelta("1ms")


def _keyed(events: DataFrame, step: Callable, out: str, state: str, idle: str | None, late: str, alarm: Callable | None = None) -> DataFrame:
    """Applies a step to each session, which is forgotten when it has been without events for `idle` by event time (ts); None: never.

    `alarm` (state -> ms, or None) may set an earlier timer, from the session's last event on; when it goes off, the step gets no batches and the time.
    """
    if idle is None:
        return events.groupBy("session_id").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)
    after = _ms(idle)

    def timed(key: tuple, batches: Iterator[pd.DataFrame], own: GroupState) -> Iterator[pd.DataFrame]:
        if own.hasTimedOut:
            *kept, last, rung = own.get
            due = alarm(tuple(kept)) if alarm and not rung else None
            if due is None:
                own.remove()
                return
            inner = _Kept(tuple(kept))
            yield from step(key, iter(()), inner, last + due)
            own.update((*inner.get, last, True))
            own.setTimeoutTimestamp(max(last + after, own.getCurrentWatermarkMs() + 1))
            return
        rows = _in_order(batches)
        inner, last = (_Kept(own.get[:-2]), own.get[-2]) if own.exists else (_Kept(None), None)
        times = rows["_ms"].to_numpy()
        before = np.concatenate([times[:1] if last is None else [last], np.maximum.accumulate(np.maximum(times, times[0] if last is None else last))[:-1]])
        cuts = np.flatnonzero(times - before > after).tolist()  # events that come back after `idle` start anew
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            if a < b:
                inner = _Kept(None) if a in cuts else inner
                yield from step(key, iter([rows.iloc[a:b]]), inner)
        # an event that comes late still moves the end on from the watermark
        last = max(int(times.max()), last or 0)
        due = alarm(inner.get) if alarm else None
        own.update((*inner.get, last, due is None))
        own.setTimeoutTimestamp(max(last, own.getCurrentWatermarkMs()) + (after if due is None else min(due, after)))

    stored = f"{state}, last long, rung boolean"
    return events.withWatermark("ts", late).withColumn("_ms", F.unix_millis("ts")).groupBy("session_id").applyInPandasWithState(timed, out, stored, "append", GroupStateTimeout.EventTimeTimeout)


class _Kept:
    """The step's own part of a session's state."""

    def __init__(self, values: tuple | None):
        self.get, self.exists = values, values is not None

    def update(self, values: tuple) -> None:
        self.get, self.exists = values, True


def _moments(values: np.ndarray, first: int, window: int, update: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of values that follow `first` earlier ones: whether the moments are renewed at each, and the mean and deviation of its window."""
    n = len(values) - first
    size = np.minimum(np.arange(first, len(values)) + 1, window)
    mean, std = np.zeros(n), np.ones(n)
    few = int((size < window).sum())
    for i in range(few):  # the first windows of a session
        mean[i], std[i] = values[: first + i + 1].mean(), values[: first + i + 1].std() if first + i else 1.0
    for a in range(few, n, WINDOWS):
        b = min(n, a + WINDOWS)
        views = np.lib.stride_tricks.sliding_window_view(values[first + a + 1 - window : first + b], window)
        mean[a:b], std[a:b] = views.mean(axis=1), views.std(axis=1) if window > 1 else 1.0
    return (size < update) | (size % update == 0), mean, std


def stream_rolling_zscore(events: DataFrame, window: int = 200, update: int = 50, idle: str | None = IDLE, late: str = "10 seconds") -> DataFrame:
    """rolling_zscore as state: the last `window` values with the mean and deviation in force. Order in a batch is restored by chunk_idx.

    A session that is silent for `idle` by event time (ts) is forgotten, and starts anew when it comes back; with None it is kept for good."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, at: int | None = None) -> Iterator[pd.DataFrame]:
        known, mean, std = state.get if state.exists else ([], 0.0, 1.0)
        rows = _in_order(batches)
        new = rows["value"].to_numpy(dtype="float64")
        values = np.concatenate([np.array(known, "float64"), new])
        due, means, stds = _moments(values, len(known), window, update)
        force = np.maximum.accumulate(np.where(due, np.arange(len(new)), -1))
        before = np.concatenate([[-1], force[:-1]])
        means, stds = np.append(means, mean), np.append(stds, std)  # -1: what the state says
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.where(stds[before] > 0, (new - means[before]) / stds[before], np.nan)
        state.update((values[-window:].tolist(), float(means[force[-1]]), float(stds[force[-1]])))
        z = pd.Series(z, index=rows.index).astype(object).where(stds[before] > 0, None)
        yield pd.DataFrame({"session_id": key[0], "chunk_idx": rows["chunk_idx"], "value": rows["value"], "z": z})

    return _keyed(events, step, ZSCORES, "values array<double>, mean double, std double", idle, late)


def stream_inactivity(scores: DataFrame, chunk_secs: float = 0.1, finalize: float = 3.0, idle: str | None = IDLE, late: str = "10 seconds") -> DataFrame:
    """inactivity_timers as state: chunks since the last z of 0 or more, and whether a chunk crosses `finalize`; idle as in stream_rolling_zscore."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, at: int | None = None) -> Iterator[pd.DataFrame]:
        (since,) = state.get if state.exists else (0,)
        rows = _in_order(batches)
        since = _since(rows["z"], since)
        crossed = (since * chunk_secs >= finalize) & ((since - 1) * chunk_secs < finalize) & (since > 0)
        state.update((int(since[-1]),))
        yield pd.DataFrame({"session_id": key[0], "chunk_idx": rows["chunk_idx"], "z": rows["z"], "inactive_chunks": since, "finalize": crossed})

    return _keyed(scores, step, TIMERS, "since long", idle, late)


def _since(z: pd.Series, before: int) -> np.ndarray:
    """Chunks since the last z of 0 or more, which was `before` chunks ago."""
    place = np.arange(len(z))
    last = np.maximum.accumulate(np.where(z.to_numpy(dtype="float64", na_value=np.nan) >= 0, place, -1))
    return np.where(last < 0, before + place + 1, place - last)


def stream_activity(
    scores: DataFrame, chunk_secs: float = 0.1, trans_after: float = 0.5, response_after: float = 3.0, finalize: float = 3.0, idle: str = IDLE, late: str = "10 seconds",
) -> DataFrame:
    """channel_timers and force_flags as state, for chunks (session_id, chunk_idx, ts, z1, z2, event_z, probable_speaker).

    The timers go on while nothing arrives: when a session falls silent, a row without chunk_idx comes at the time when its first channel has been
    inactive for `finalize`, once the watermark is there. A session that was idle for longer is forgotten. 0 switches a flag off.
    """
    names = ["chunk_idx", "at", "ch1_inactive_secs", "ch2_inactive_secs", "activity_start_secs", "finalize", "force_transcription", "force_response"]

    def remaining(state: tuple) -> int | None:
        """How long the first channel's timer still has to go, in ms; None if it is over."""
        ms = round((finalize - state[0] * chunk_secs) * 1000)
        return ms if ms > 0 else None

    def shown(key: tuple, *columns) -> pd.DataFrame:
        out = pd.DataFrame(dict(zip(names, columns, strict=True)))
        out["chunk_idx"] = out["chunk_idx"].astype("Int64")
        out["activity_start_secs"] = out["activity_start_secs"].astype("float64")
        out.insert(0, "session_id", key[0])
        return out

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, at: int | None = None) -> Iterator[pd.DataFrame]:
        one, two, z, chunks, start = state.get if state.exists else (0, 0, 0.0, 0, None)
        if at is not None:  # silence has lasted as long as the first channel's timer had to go
            silent = finalize - one * chunk_secs
            secs = one * chunk_secs + silent, two * chunk_secs + silent
            yield shown(key, [None], [pd.Timestamp(at, unit="ms", tz="UTC")], [secs[0]], [secs[1]], [start], [True], [False], [bool(response_after and min(secs) >= response_after)])
            return
        rows = _in_order(batches)
        first, second = _since(rows["z1"], one), _since(rows["z2"], two)
        z2 = rows["z2"].to_numpy(dtype="float64", na_value=np.nan)
        rose = (z2 >= 0) & (np.concatenate([[z if z is not None else 0.0], np.nan_to_num(z2[:-1], nan=0.0)]) < 0)
        place = np.maximum.accumulate(np.where(rose, np.arange(len(rows)), -1))
        begun = [start if p < 0 else (chunks + int(p)) * chunk_secs for p in place]
        crossed = (first * chunk_secs >= finalize) & ((first - 1) * chunk_secs < finalize)
        event = rows["event_z"].to_numpy(dtype="float64", na_value=np.nan) >= 1.0
        transcribe = (second * chunk_secs >= trans_after) & event & (rows["probable_speaker"] == "user").to_numpy() & bool(trans_after)
        respond = (np.minimum(first, second) * chunk_secs >= response_after) & bool(response_after)
        last = None if np.isnan(z2[-1]) else float(z2[-1])
        state.update((int(first[-1]), int(second[-1]), last, chunks + len(rows), begun[-1]))
        yield shown(key, rows["chunk_idx"].to_numpy(), rows["ts"].to_numpy(), first * chunk_secs, second * chunk_secs, begun, crossed, transcribe, respond)

    return _keyed(scores, step, ACTIVITY, "one long, two long, z double, chunks long, start double", idle, late, remaining)


def stream_realtime_factor(events: DataFrame, chunk_secs: float = 0.1, width: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(stage, start, factor, n) of tumbling windows over ts."""
    factor = F.lit(chunk_secs) / (F.col("elapsed_secs") + 1e-8)
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "stage").agg(F.avg(factor).alias("factor"), F.count("*").alias("n")).select("stage", F.col("window.start").alias("start"), "factor", "n")


def stream_activity_sessions(events: DataFrame, gap: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """(session_id, start, end, n) of islands of activity that a gap of silence closes."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "session_id").agg(F.count("*").alias("n")).select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_clean_transcripts(lines: DataFrame, text: str = "text") -> DataFrame:
    c = F.col(text)
    return lines.withColumn("clean", clean_line(c)).withColumn("asr", clean_asr_text(c)).withColumn("tts", sanitize_for_tts(c)).withColumn("turns", F.size(turns_of_sequence(c)))


def stream_split(rows: DataFrame, index: Column, percent: int) -> tuple[DataFrame, DataFrame]:
    """(validation, training) of a stream by a stable index."""
    m = F.pmod(index, F.lit(100))
    return rows.filter(m < percent), rows.filter(m > percent)
