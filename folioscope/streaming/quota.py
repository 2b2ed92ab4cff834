"""A day quota with spending and refunds, kept as the state of a stream.

Rows (identity, ts, action, request, received) are counted by identity and the UTC day of ts, in the order in which they come
and, within a micro-batch, of ts and request. A ``spend`` adds one and is allowed while the count is at most ``most``; a
``refund`` takes one back if there is one. A request counts once for each action, however often it comes.

The watermark follows ``received``, when a row came, so that Spark drops no row for a late ts. The state of a day lives until
the watermark is ``keep`` beyond the day's end, then a timer drops it. A row that comes for a day whose state is gone can't
be counted: with ``strict`` it is refused, otherwise let through, both with count 0 and ``checked`` false. Rows with a null
identity or ts are such rows as well; rows without a request, or of another action, are left out. The state of one key is
bounded by that identity's requests of one day.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SPEND, REFUND = "spend", "refund"
_OUT = "identity string, day date, request string, action string, allowed boolean, count int, checked boolean"


def decide(rows: list[tuple[str, str]], count: int, seen: set[str], most: int) -> tuple[list[tuple[bool, int]], int]:
    """What becomes of (action, request) rows in their order, after the count before; seen is added to."""
    out = []
    for action, request in rows:
        fresh = f"{action}:{request}" not in seen
        seen.add(f"{action}:{request}")
        if fresh:
            count = count + 1 if action == SPEND else max(0, count - 1)
        out.append((action == REFUND or count <= most, count))
    return out, count


def day_quota(events: DataFrame, most: int, strict: bool = False, skew: str = "1 hour", keep: timedelta = timedelta(days=2)) -> DataFrame:
    """(identity, day, request, action, allowed, count, checked) of each row of a stream of events. skew: by how much the
    sources' ``received`` may differ."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        identity, day = key
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts))
        rows = rows.sort_values(["ts", "request", "action"], kind="stable")
        pairs = list(zip(rows["action"], rows["request"], strict=True))
        usable = identity is not None and not pd.isna(day)
        if usable:
            ends = datetime.combine(day, datetime.min.time(), UTC) + timedelta(days=1) + keep
            limit = int(ends.timestamp() * 1000)
            usable = limit > state.getCurrentWatermarkMs()
        if not usable:
            found, checked = [(not strict, 0)] * len(pairs), False
        else:
            count, seen = state.get if state.exists else (0, "")
            held = set(seen.split("\n")) - {""}
            found, count = decide(pairs, count, held, most)
            state.update((count, "\n".join(sorted(held))))
            state.setTimeoutTimestamp(limit)
            checked = True
        yield pd.DataFrame({"identity": identity, "day": day, "request": rows["request"], "action": rows["action"], "allowed": [a for a, _ in found], "count": [c for _, c in found], "checked": checked})

    known = events.withWatermark("received", skew).filter(F.col("action").isin(SPEND, REFUND) & F.col("request").isNotNull())
    keyed = known.select("identity", F.to_date("ts").alias("day"), "ts", "action", "request", "received").groupBy("identity", "day")
    return keyed.applyInPandasWithState(run, _OUT, "count int, seen string", "append", GroupStateTimeout.EventTimeTimeout)
