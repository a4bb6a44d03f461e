"""Streams with custom keyed state (``applyInPandasWithState``).

A micro-batch's rows of one key are ordered by time before they are walked; the
trigger's byte limit bounds how many there are. State is small and bounded per key.

These verdicts depend on the order of events, so the input must come in time order from
micro-batch to micro-batch (within one, any order will do). A row that is older than what its
key has already seen is not lost: it leaves the stream at once with ``late`` set and no verdict,
and does not touch the state. No watermark, so nothing is dropped on the way. Where the events are
stored, :func:`settled` walks the keys of late rows again from the start, in batch, so that every row
gets the verdict of the true order. Every row carries its key as ``key``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..functions.limits import AbuseGuard, Breaker, SlidingLog
from ..operators.ordered import micros
from ..operators.topn import top_n_per_group
from ..session import materialize
from .runner import ROCKS

STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": ROCKS}
#: Shares of a key in ``retain_last``.
SHARES = 16

Load = Callable[[tuple | None], object]
Walk = Callable[[object, pd.DataFrame], list[tuple]]
Save = Callable[[object], tuple]


def _keyed(events: DataFrame, key: str, row_id: str, ts: str, **extra: Column) -> DataFrame:
    return events.select(
        F.col(key), F.col(row_id).alias("id"), micros(F.col(ts)).alias("at"),
        *[c.alias(n) for n, c in extra.items()],
    )


def _stateful(rows: DataFrame, key: str, output: str, state_schema: str, load: Load, walk: Walk, save: Save) -> DataFrame:
    """Keep an object per key: ``load`` it from its saved tuple, ``walk`` the rows, ``save`` it."""
    names = [part.split()[0] for part in output.split(", ")]
    told = f"{output}, late boolean, key {rows.schema[key].dataType.simpleString()}"
    if not rows.isStreaming:
        return _in_order(rows, key, names, told, load, walk)

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, saved = (state.get[:2], state.get[2:]) if state.exists else (None, None)
        pdf = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        if seen is not None:
            # rows of one time are ordered by id, across micro-batches too
            before = (pdf["at"] < seen[0]) | ((pdf["at"] == seen[0]) & (pdf["id"] < seen[1]))
            late, pdf = pdf[before], pdf[~before]
            if len(late):
                yield late[["id"]].reindex(columns=names).astype(object).where(lambda x: x.notna(), None).assign(late=True, key=group[0])
        if len(pdf):
            held = load(saved)
            out = walk(held, pdf)
            state.update((int(pdf["at"].iloc[-1]), int(pdf["id"].iloc[-1]), *save(held)))
            yield pd.DataFrame(out, columns=names).assign(late=False, key=group[0])

    return rows.groupBy(key).applyInPandasWithState(
        run, told, f"seen bigint, seen_id bigint, {state_schema}", "append", GroupStateTimeout.NoTimeout
    )


def _in_order(rows: DataFrame, key: str, names: list[str], told: str, load: Load, walk: Walk) -> DataFrame:
    """The same walk over stored rows: sorted Arrow batches, the object of one key in memory."""
    # a text label, so that a NULL key compares equal to itself in the walk
    label = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    ordered = rows.withColumn("_group", label).repartition("_group").sortWithinPartitions("_group", "at", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, None
        for pdf in batches:
            for group, part in pdf.groupby("_group", sort=False):
                if group != current:
                    current, held = group, load(None)
                yield pd.DataFrame(walk(held, part), columns=names).assign(late=False, key=part[key].to_numpy())

    return ordered.mapInPandas(run, told)


def settled(found: DataFrame, verdicts: Callable[[DataFrame], DataFrame], events: DataFrame, key: str) -> DataFrame:
    """``found``, what a stream of ``verdicts`` wrote, with the keys of late rows walked again over the stored ``events``."""
    keys = materialize(found.filter("late").select(F.col("key").alias("_key")).distinct(), "late-keys")
    if keys.isEmpty():
        return found
    again = verdicts(events.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi"))
    return found.join(keys, F.col("key").eqNullSafe(F.col("_key")), "left_anti").unionByName(again)


def rate_limit(events: DataFrame, key: str, row_id: str, ts: str, limit: int = fixed.RATE_LIMIT_REQUESTS,
               window: int = fixed.RATE_LIMIT_WINDOW_SECONDS) -> DataFrame:
    """Sliding-log verdict on every request; the state is the admitted times still in the window."""

    def walk(log: SlidingLog, pdf: pd.DataFrame) -> list[tuple]:
        return [(i, *log.admit(at)) for i, at in zip(pdf["id"].tolist(), pdf["at"].tolist())]

    return _stateful(
        _keyed(events, key, row_id, ts), key,
        "id bigint, allowed boolean, remaining bigint, reset_seconds bigint", "times array<bigint>",
        lambda saved: SlidingLog(limit, window, deque(saved[0] if saved else ())), walk,
        lambda log: (list(log.log),),
    )


def abuse_block(events: DataFrame, key: str, row_id: str, ts: str, bot: Column, limit: int = fixed.RATE_LIMIT_REQUESTS,
                window: int = fixed.RATE_LIMIT_WINDOW_SECONDS, threshold: int = fixed.ABUSE_THRESHOLD,
                block_seconds: int = fixed.ABUSE_BLOCK_SECONDS) -> DataFrame:
    """Verdict on every request: ok, rate_limited, bot or blocked."""

    def load(saved: tuple | None) -> AbuseGuard:
        times, refusals, until = saved or ((), 0, 0)
        return AbuseGuard(SlidingLog(limit, window, deque(times)), threshold, block_seconds, refusals, until)

    def walk(guard: AbuseGuard, pdf: pd.DataFrame) -> list[tuple]:
        return [(i, guard.step(at, bool(b))) for i, at, b in
                zip(pdf["id"].tolist(), pdf["at"].tolist(), pdf["bot"].tolist())]

    return _stateful(
        _keyed(events, key, row_id, ts, bot=bot), key, "id bigint, verdict string",
        "times array<bigint>, refusals bigint, blocked_until bigint", load, walk,
        lambda guard: (list(guard.log.log), guard.refusals, guard.blocked_until),
    )


def circuit_breaker(events: DataFrame, key: str, row_id: str, ts: str, ok: Column) -> DataFrame:
    """Breaker state of each service after every call."""

    def walk(breaker: Breaker, pdf: pd.DataFrame) -> list[tuple]:
        out = []
        for i, at, good in zip(pdf["id"].tolist(), pdf["at"].tolist(), pdf["ok"].tolist()):
            allowed = breaker.step(at, bool(good))
            out.append((i, allowed, breaker.state, breaker.failures))
        return out

    return _stateful(
        _keyed(events, key, row_id, ts, ok=ok), key, "id bigint, allowed boolean, state string, failures bigint",
        "state string, failures bigint, successes bigint, last_failure bigint",
        lambda saved: Breaker(*saved) if saved else Breaker(), walk,
        lambda b: (b.state, b.failures, b.successes, b.last_failure),
    )


def session_items(events: DataFrame, key: str, row_id: str, ts: str) -> DataFrame:
    """Newest items of each live session at every row; a session idle for too long starts empty."""
    idle = fixed.SESSION_IDLE_SECONDS * 1_000_000

    def load(saved: tuple | None) -> deque:
        return deque(zip(*saved) if saved else (), maxlen=fixed.SESSION_MAX_ITEMS)

    def walk(items: deque, pdf: pd.DataFrame) -> list[tuple]:
        out = []
        for i, at in zip(pdf["id"].tolist(), pdf["at"].tolist()):
            if items and at - items[-1][1] > idle:
                items.clear()
            items.append((i, at))
            out.append((i, len(items), items[0][0]))
        return out

    return _stateful(
        _keyed(events, key, row_id, ts), key, "id bigint, items bigint, oldest bigint",
        "ids array<bigint>, times array<bigint>", load, walk,
        lambda items: ([i for i, _ in items], [at for _, at in items]),
    )


def retain_last(events: DataFrame, key: str, row_id: str, ts: str, n: int = 1000, shares: int = SHARES) -> DataFrame:
    """Newest ``n`` rows of each share of a key; every micro-batch reports what is retained.

    A busy key is spread over ``shares`` by a hash of the row's id; :func:`retained` joins them.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, ids, times = state.get if state.exists else (0, [], [])
        kept = pd.DataFrame({"id": ids, "at": times}, dtype="int64")
        for pdf in batches:
            # never more than n rows and one Arrow batch in memory
            kept = pd.concat([kept, pdf[["id", "at"]]]).sort_values(["at", "id"]).tail(n)
        state.update((version + 1, kept["id"].tolist(), kept["at"].tolist()))
        yield pd.DataFrame({
            "label": [group[0]], "share": [group[1]], "version": [version + 1], "ids": [kept["id"].tolist()], "times": [kept["at"].tolist()],
        })

    share = F.pmod(F.xxhash64(row_id), F.lit(shares))
    return _keyed(events, key, row_id, ts, share=share).groupBy(key, "share").applyInPandasWithState(
        run, "label string, share bigint, version bigint, ids array<bigint>, times array<bigint>",
        "version bigint, ids array<bigint>, times array<bigint>", "append", GroupStateTimeout.NoTimeout,
    )


def retained(reports: DataFrame, n: int = 1000) -> DataFrame:
    """label, id and time of the newest ``n`` rows of each key, from the last report of each share."""
    latest = reports.groupBy("label", "share").agg(F.max_by(F.arrays_zip("ids", "times"), "version").alias("rows"))
    rows = latest.select("label", "share", F.inline("rows")).select("label", "share", F.col("ids").alias("id"), F.col("times").alias("at"))
    return top_n_per_group(rows, ["label"], [F.desc("at"), F.desc("id")], n, spread_on=["share"])
