"""Deduplication of at-least-once chat updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docrisk import dims

_KEY, _ARRIVED = "_k", "_arrived"
#: Groups that ids are dealt into for the exact form: each keeps one piece of state and is one call a batch.
BUCKETS = 256


def _keyed(updates: DataFrame) -> DataFrame:
    # an update without an id is never a duplicate: it gets a key of its own, which also
    # spreads such updates over all tasks
    return updates.withColumn(_KEY, F.coalesce(F.col("update_id").cast("string"), F.uuid()))


def dedup_updates(
    updates: DataFrame, horizon: str = dims.DEDUP_HORIZON, exact: bool = False, clock: Column | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Drop updates whose id was seen within ``horizon`` of its first processing.

    ``clock`` is the time at which an update arrives: that of the micro-batch, unless given. It must not
    go back from batch to batch, so a first delivery always comes out, however old its own time is. A
    backlog that is replayed at once arrives at one time, so it loses deliveries that the batch form
    (``first_updates``, by event time) admits again; give the event time as the clock to keep them.
    The default works inside the JVM. An id is forgotten once the stream is ``horizon`` past its first
    arrival: Spark keeps it for the watermark's delay, and the watermark is that delay behind, so the
    delay is half the horizon; it moves between batches, so a repeat may still be dropped in the first
    batch after the horizon. ``exact`` keeps to the horizon by every row's own clock and reports repeats with
    ``duplicate = true`` instead of dropping them. It runs Python, once for each of ``buckets`` groups of
    ids and batch.
    """
    clock = F.current_timestamp() if clock is None else clock
    if exact:
        return _flag_repeats(updates, horizon, clock, buckets)
    half = f"{int(pd.Timedelta(horizon).total_seconds() * 500)} milliseconds"
    arrived = _keyed(updates).withColumn(_ARRIVED, clock)
    return arrived.withWatermark(_ARRIVED, half).dropDuplicatesWithinWatermark([_KEY]).drop(_KEY, _ARRIVED)


def first_of_runs(ids: np.ndarray, times: np.ndarray, known: np.ndarray, until: np.ndarray, span: int):
    """Which rows are no repeats, and the state after them.

    ``known`` (sorted) are ids seen before and ``until`` when each is forgotten; a row is a repeat if its
    time is no later. Rows of an id are taken by time, equal times as they came. All ids are worked on at
    once: each step finds the next row of every id that is no repeat, so there are as many steps as one id
    has such rows.
    """
    order = np.lexsort((np.arange(len(ids)), times, ids))
    i, t = ids[order], times[order]
    begin = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(i))
    each = i[begin]
    limit = np.full(len(each), np.iinfo(np.int64).min)
    if len(known):
        at = np.minimum(np.searchsorted(known, each), len(known) - 1)
        limit = np.where(known[at] == each, until[at], limit)
    first = np.zeros(len(i), bool)
    low, left = begin.copy(), np.arange(len(each))
    while len(left):
        # the first row of each id that is later than its limit
        a, b = low[left], end[left]
        while (a < b).any():
            mid = (a + b) // 2
            later = t[np.minimum(mid, len(t) - 1)] > limit[left]
            open_ = a < b
            b = np.where(open_ & later, mid, b)
            a = np.where(open_ & ~later, mid + 1, a)
        some = a < end[left]
        left, a = left[some], a[some]
        first[a] = True
        limit[left] = t[a] + span
        low[left] = a + 1
    flags = np.empty(len(i), bool)
    flags[order] = first
    others = ~np.isin(known, each)
    ids, until = np.concatenate([known[others], each]), np.concatenate([until[others], limit])
    order = np.argsort(ids, kind="stable")
    return flags, ids[order], until[order]


_STATE = "ids binary, until binary"
_ID, _NAMED, _CLOCK, _ROW, _BUCKET = "_id", "_named", "_clock", "_row", "_bucket"
# times keep their microseconds on the way through JSON
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _flagger(span: int):
    """The stateful function of a bucket: two packed arrays are all its state."""

    def flag(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = until = np.zeros(0, np.int64)
        if state.exists:
            known, until = (np.frombuffer(b, np.int64) for b in state.get)
        now = np.iinfo(np.int64).min
        for frame in frames:
            named, times = frame[_NAMED].to_numpy(bool), frame[_CLOCK].to_numpy(np.int64)
            repeat = np.zeros(len(frame), bool)
            first, known, until = first_of_runs(frame[_ID].to_numpy(np.int64)[named], times[named], known, until, span)
            repeat[named] = ~first
            now = max(now, int(times.max(initial=now)))
            yield pd.DataFrame({_ROW: frame[_ROW], "duplicate": repeat})
        alive = until >= now
        state.update((known[alive].tobytes(), until[alive].tobytes()))

    return flag


def _flag_repeats(updates: DataFrame, horizon: str, clock: Column, buckets: int) -> DataFrame:
    span = int(pd.Timedelta(horizon).total_seconds() * 1_000_000)
    # rows pass through Python as one text each, so that nested values are not taken apart there
    named = F.col("update_id").isNotNull()
    dealt = updates.select(
        F.coalesce(F.col("update_id").cast("bigint"), F.lit(0).cast("bigint")).alias(_ID),
        named.alias(_NAMED),
        F.unix_micros(clock.cast("timestamp")).alias(_CLOCK),
        F.to_json(F.struct(*updates.columns), _JSON).alias(_ROW),
        # updates without an id are never repeats: they go anywhere
        F.pmod(F.when(named, F.xxhash64(F.col("update_id").cast("bigint"))).otherwise(F.xxhash64(F.uuid())), F.lit(buckets)).alias(_BUCKET),
    )
    flagged = dealt.groupBy(_BUCKET).applyInPandasWithState(
        _flagger(span), f"{_ROW} string, duplicate boolean", _STATE, "append", GroupStateTimeout.NoTimeout
    )
    row = F.from_json(_ROW, updates.schema, _JSON)
    return flagged.select(row.alias(_ROW), "duplicate").select(f"{_ROW}.*", "duplicate")
