"""The frontier as a stream: source, sink, visited filter and politeness with state.

Files stand in for the message queue; `source_format` and `options` switch the same jobs to a queue.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from webloom.operators import frontier as batch
from webloom.operators.links import latest
from webloom.operators.politeness import PERIOD_SECONDS, admit, admitted_positions, micros
from webloom.session import remove_written, written
from webloom.sources import leveled
from webloom.sources.versioned import read_versions, version_of, write_batch, write_version

LAST_SCHEMA = T.StructType([T.StructField("domain", T.StringType()), T.StructField("since", T.LongType())])
VISITED_SCHEMA = T.StructType([T.StructField("url_key", T.StringType())])
FLUSH_SECONDS = 30  # fixed value: longest time a row waits before it is written


def read_frontier(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    source_format: str = "parquet",
    max_files: int | None = None,
    **options: str,
) -> DataFrame:
    """Stream of frontier rows; `max_files` per micro batch keeps a backlog from arriving at once."""
    reader = spark.readStream.format(source_format).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path)


def write_frontier(
    rows: DataFrame, path: str, checkpoint: str, sink_format: str = "parquet", once: bool = True
) -> StreamingQuery:
    """Append rows to the frontier."""
    writer = rows.writeStream.format(sink_format).option("checkpointLocation", checkpoint).outputMode("append")
    return _triggered(writer, once).start(path)


def _triggered(writer: Any, once: bool) -> Any:
    """Either everything that is available now, or a micro batch at least every flush period."""
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{FLUSH_SECONDS} seconds")


def visited_filter(
    visited_path: str | leveled.Store, sink_path: str, outcomes_path: str | None = None, mark: bool = True
):
    """foreachBatch function: drop URLs seen before, write the rest to the sink and their keys to the visited table.

    With `mark` False no keys are written: the page store marks what was fetched, so that a failed fetch and a row that
    politeness sends back may pass again.

    Every write of a batch has a version of its own, so a repeated batch replaces its own output. Versions from this
    one on are left out of the comparison, or a repeated batch would find its own keys. The visited set is
    scanned and not shuffled: the keys of the batch are written first, so the planner sees that they are few. If it is a
    store with levels (`visited_store`), only the buckets of the batch's keys are read, and the number of its files does
    not grow with the number of batches.

    With `outcomes_path` the numbers of rows passed on, skipped as visited and refused for lack of a domain are
    written there as `(outcome, n)`.
    """

    def run(rows: DataFrame, batch_id: int) -> None:
        keyed = written(batch.keyed(rows), "keyed")
        arrived = written(batch.first_per_key(keyed.filter("domain IS NOT NULL")), "arrived")
        fresh = written(arrived.join(seen_before(arrived, visited_path, batch_id), "url_key", "left_anti"), "fresh")
        write_batch(fresh, sink_path, batch_id)
        if mark:
            mark_keys(fresh.select("url_key"), visited_path, batch_id)
        if outcomes_path:
            write_batch(_outcomes(keyed, fresh), outcomes_path, batch_id)
        remove_written(keyed, arrived, fresh)

    return run


def visited_store(path: str, buckets: int) -> leveled.Store:
    """The visited set as a store with levels; keys are marked once."""
    return leveled.Store(path, VISITED_SCHEMA, ("url_key",), buckets, grows_only=True)


def seen_before(arrived: DataFrame, visited: str | leveled.Store, batch_id: int) -> DataFrame:
    """Those url_keys of a micro batch that versions before its own hold."""
    spark, keys = arrived.sparkSession, arrived.select("url_key")
    if isinstance(visited, leveled.Store):
        return leveled.lookup(spark, visited, keys, leveled.earlier(spark, visited, batch_id))
    own = version_of(spark, visited, batch_id)
    earlier = read_versions(spark, visited, VISITED_SCHEMA).filter(f"version < {own}")
    return earlier.select("url_key").join(keys, "url_key", "left_semi").distinct()


def mark_keys(keys: DataFrame, visited: str | leveled.Store, batch_id: int) -> None:
    """Write the keys of a micro batch, which are new to the visited set."""
    if isinstance(visited, leveled.Store):
        leveled.append(keys, visited, batch_id)
    else:
        write_batch(keys, visited, batch_id)


def _outcomes(keyed: DataFrame, fresh: DataFrame) -> DataFrame:
    refused = F.count(F.when(F.col("domain").isNull(), 1))
    arrived = keyed.agg(refused.alias("no_domain"), (F.count(F.lit(1)) - refused).alias("kept"))
    counted = arrived.withColumn("passed", fresh.agg(F.count(F.lit(1))).scalar())
    return counted.select(
        F.explode(
            F.create_map(
                F.lit("no_domain"),
                "no_domain",
                F.lit("unvisited"),
                "passed",
                F.lit("visited_skip"),
                F.col("kept") - F.col("passed"),
            )
        ).alias("outcome", "n")
    )


def start_visited_filter(
    rows: DataFrame,
    visited_path: str | leveled.Store,
    sink_path: str,
    checkpoint: str,
    once: bool = True,
    outcomes_path: str | None = None,
    mark: bool = True,
) -> StreamingQuery:
    """Streaming visited filter over `rows(url, ts, ...)`.

    `visited_path` must hold at least one version; use `create_visited`, or `leveled.create`, for a new table. Visited URLs never expire, so
    they live in a table and not in operator state, which would grow without bound.
    """
    run = visited_filter(visited_path, sink_path, outcomes_path, mark)
    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _triggered(writer, once).start()


def create_visited(spark: SparkSession, path: str, keys: DataFrame | None = None) -> None:
    """A visited table with the given keys as version -1, before every batch."""
    rows = keys.select("url_key").distinct() if keys is not None else spark.createDataFrame([], VISITED_SCHEMA)
    write_version(rows, path, -1)


def politeness_batches(
    state_path: str, sink_path: str, period_seconds: int = PERIOD_SECONDS, requeue_path: str | None = None
):
    """foreachBatch function: admission of a micro batch, with the last admission per domain in a table.

    Uses the batch operator, so a domain with most of the arrivals is cut into blocks here too. Writes
    `(arrival_id, domain, url, ts, admitted)` to the sink. With `requeue_path` refused rows go back to the frontier,
    one period later, in a folder of their own per batch; read such a frontier with recursiveFileLookup.
    """

    def run(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        rows = written(rows, "batch")
        domains = written(rows.select("domain").distinct(), "domains")
        own = version_of(spark, state_path, batch_id)
        stored = read_versions(spark, state_path, LAST_SCHEMA).filter(f"version < {own}")
        earlier = written(latest(stored.join(domains, "domain", "left_semi"), ("domain",), "version"), "earlier")
        checked = admit(rows, period_seconds, earlier=earlier.select("domain", "since"))
        version = write_batch(checked, sink_path, batch_id)
        written_rows = spark.read.parquet(f"{sink_path}/version={version}")
        if requeue_path:
            later = F.timestamp_micros(micros(written_rows) + F.lit(period_seconds * 1_000_000).cast("long"))
            again = written_rows.filter("NOT admitted").withColumn("ts", later.cast(rows.schema["ts"].dataType))
            target = f"{requeue_path.rstrip('/')}/requeued-{version}"
            again.select("arrival_id", "domain", "url", "ts").write.mode("overwrite").parquet(target)
        done = written_rows.filter("admitted")
        write_batch(done.groupBy("domain").agg(F.max(micros(done)).alias("since")), state_path, batch_id)
        remove_written(rows, domains, earlier)

    return run


def start_politeness(
    rows: DataFrame,
    state_path: str,
    sink_path: str,
    checkpoint: str,
    period_seconds: int = PERIOD_SECONDS,
    once: bool = True,
    requeue_path: str | None = None,
) -> StreamingQuery:
    """Admission over a stream of `rows(arrival_id, domain, url, ts)`; start a new state with `create_state`."""
    run = politeness_batches(state_path, sink_path, period_seconds, requeue_path)
    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _triggered(writer, once).start()


def create_state(spark: SparkSession, path: str) -> None:
    write_version(spark.createDataFrame([], LAST_SCHEMA), path, -1)


class PolitenessState(StatefulProcessor):
    """Keeps the last admission of a domain; event time decides, so a replay admits the same rows.

    For low latency and sources that limit a micro batch: one task handles the rows of a domain in a micro batch, in the
    pieces in which they come. `start_politeness` has no such limit. With `expire` a timer clears the state of a domain
    when the watermark has passed its period: no row that is not late can be refused then.
    """

    def __init__(self, period_seconds: int, expire: bool = False) -> None:
        self.period, self.expire = period_seconds * 1_000_000, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("ts", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Admit the rows of one domain in one micro batch; the rows are neither copied together nor sorted, their times are."""
        pieces = [piece[["arrival_id", "domain", "url", "us"]] for piece in rows]
        us, number = (np.concatenate([p[c].to_numpy() for p in pieces]) for c in ("us", "arrival_id"))
        order = np.lexsort((number, np.concatenate([p["url"].to_numpy(dtype=object) for p in pieces]).astype(str), us))
        held = self.last.get()  # every call is a message to the state store and back
        last = held[0] if held else None
        flags = np.empty(len(us), dtype=bool)
        flags[order], now = admitted_positions(us[order], self.period, last)
        if now is not None and now != last:
            self.last.update((int(now),))
            if self.expire:
                if last is not None:
                    self.handle.deleteTimer(expiry_millis(last, self.period))  # the one of the admission before
                self.handle.registerTimer(expiry_millis(int(now), self.period))
        done = 0
        for piece in pieces:
            found = piece.rename(columns={"us": "ts"})
            yield found.assign(admitted=flags[done : done + len(piece)])
            done += len(piece)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def expiry_millis(last: int, period: int) -> int:
    """When the period after an admission is over for certain, in milliseconds; both arguments are in microseconds."""
    return (last + period) // 1000 + 1


def politeness_stream(
    rows: DataFrame, period_seconds: int = PERIOD_SECONDS, late_seconds: int | None = None
) -> DataFrame:
    """Stream of `rows(arrival_id, domain, url, ts)` with `admitted`; ts comes out in microseconds.

    State per domain is one number. Rows with admitted = false go back to the frontier. With `late_seconds` the stream
    has a watermark that many seconds behind the latest arrival: rows behind it are dropped, and domains that had no
    admission within their period before it have no state any more. Without, state is kept for ever.
    """
    keyed = rows.filter("domain IS NOT NULL").select("arrival_id", "domain", "url", micros(rows).alias("us"))
    expire = late_seconds is not None
    if expire:
        keyed = keyed.withColumn("seen", F.timestamp_micros("us")).withWatermark("seen", f"{late_seconds} seconds")
    return keyed.groupBy("domain").transformWithStateInPandas(
        statefulProcessor=PolitenessState(period_seconds, expire),
        outputStructType="arrival_id long, domain string, url string, ts long, admitted boolean",
        outputMode="append",
        timeMode="eventTime" if expire else "none",
    )


def open_domains(spark: SparkSession, checkpoint: str) -> DataFrame:
    """domain, since: the state that a `politeness_stream` holds at the moment, read from its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    return state.select("key.domain", F.col("value.ts").alias("since"))
