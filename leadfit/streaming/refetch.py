"""Which urls are due for another fetch, kept up to date by a stream of fetch results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadfit import fixed_values as fv

FRESH_MS = fv.FRESH_HOURS * 3_600_000
EVENT = "url string, fetched_ms long, status int, reason string"


def refetch_events(fetches: DataFrame) -> DataFrame:
    """Stream of fetch results (url, status, fetched_at) -> (url, status, reason, fetched_at), a row for each turn of a url:
    `usable` when its latest result can be used, `retry` when that result asks for a retry, `expired` when a usable one
    grows older than 72 hours.

    The watermark is the time of the newest result, carried on the time until which a result is fresh: the rows that Spark
    drops as late are then just those that are out of date when they arrive, and every other order of arrival gives the
    same last turn. A row without url and with status 0 is a tick: it only moves the clock. Results without a response
    (status 0) are never kept. Of results of one time the larger status counts. Time is read in
    whole milliseconds; a result that comes in its very last one expires a millisecond late.

    State: time and status of the latest result of each url fetched in the last 72 hours, a timer each. A hot url's rows
    come to its task in portions; nothing is gathered.
    """
    timed = fetches.select(
        "url", F.col("status").cast("int").alias("status"), F.unix_millis(F.col("fetched_at").cast("timestamp")).alias("fetched_ms"))
    timed = timed.where(F.col("fetched_ms").isNotNull()).withColumn("fresh_until", F.timestamp_millis(F.col("fetched_ms") + FRESH_MS))
    # fresh until the very end of the 72 hours, so the clock stands one millisecond back
    clocked = timed.withWatermark("fresh_until", f"{FRESH_MS + 1} milliseconds")
    find = _turn_finder(FRESH_MS, frozenset(fv.RETRY_STATUSES))
    turns = clocked.groupBy("url").applyInPandasWithState(find, EVENT, "fetched_ms long, status int", "append", GroupStateTimeout.EventTimeTimeout)
    return turns.select("url", "status", "reason", F.timestamp_millis("fetched_ms").alias("fetched_at"))


def _turn_finder(fresh_ms: int, retry_statuses: frozenset[int]) -> Callable:
    """The function of a url's state. It carries what it needs, so workers needn't import this package."""
    def turns(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        url = key[0]
        kept = tuple(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            state.remove()
            if kept[1] not in retry_statuses:
                out.append((url, *kept, "expired"))
        else:
            latest = kept
            for chunk in chunks:
                told = chunk[chunk["status"].notna() & (chunk["status"] != 0)]
                if len(told):
                    top = told.sort_values(["fetched_ms", "status"]).iloc[-1]
                    found = (int(top["fetched_ms"]), int(top["status"]))
                    latest = found if latest is None else max(latest, found)
            if url is not None and latest is not None:
                retry = latest[1] in retry_statuses
                if latest != kept:
                    out.append((url, *latest, "retry" if retry else "usable"))
                ends, clock = latest[0] + fresh_ms - 1, state.getCurrentWatermarkMs()
                if ends >= clock:
                    state.update(latest)
                    state.setTimeoutTimestamp(max(ends, clock + 1))  # a timer must lie ahead of the clock
                else:  # out of date within the batch that brought it
                    if state.exists:
                        state.remove()
                    if not retry:
                        out.append((url, *latest, "expired"))
        yield pd.DataFrame(out, columns=["url", "fetched_ms", "status", "reason"])

    return turns


def follow_fetches(fetches: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Writes the turns of all urls to `log`, each once; ends when no result is left."""
    return (
        refetch_events(fetches).writeStream.format("parquet").outputMode("append")
        .option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def due_urls(needed: DataFrame, turns: DataFrame) -> DataFrame:
    """Needed urls whose last turn isn't `usable`: what `urls_to_refetch` gives at the time of the newest result or tick."""
    order = F.struct("fetched_at", "status", F.col("reason") == "expired")
    last = turns.groupBy("url").agg(F.max_by("reason", order).alias("reason"))
    return needed.join(last.where(F.col("reason") == "usable"), "url", "left_anti").distinct()
