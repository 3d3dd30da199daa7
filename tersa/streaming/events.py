"""Streams: windows over event time, a log reducer, and expiring deduplication."""

from __future__ import annotations

import datetime
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators.tables import materialize


def source(spark: SparkSession, path: str, schema, per_batch: int = 1000) -> DataFrame:
    """A stream over the files of a folder; ``ts`` without time zone becomes a time stamp, as watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(rows: DataFrame, width: str, late: str) -> DataFrame:
    """start, event_type, n, total of each window."""
    sums = rows.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(rows: DataFrame, width: str, step: str, late: str) -> DataFrame:
    """start, event_type, n of each window that begins every ``step``."""
    sums = rows.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))
    return sums.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(rows: DataFrame, gap: str) -> DataFrame:
    """user_id, start, end, n of events without a pause of ``gap``."""
    sums = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return sums.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def reduce_log(rows: DataFrame, line, pos: str) -> DataFrame:
    """key, n, worst severity rank, the first line of that severity, first and last position of each template."""
    rank = X.severity_rank(X.severity(line))
    sums = rows.groupBy(X.log_template(line).alias("key")).agg(F.count("*").alias("n"), F.max(rank).alias("rank"), F.min(F.struct(-rank, F.col(pos), X.shorten(line).alias("line"))).alias("s"), F.min(pos).alias("first_seen"), F.max(pos).alias("last_seen"))
    return sums.select("key", "n", "rank", F.col("s.line").alias("sample"), "first_seen", "last_seen")


#: Seconds for which a cached row is fresh, and for which it may be used.
FRESH, USABLE = 60, 300


def freshness(made, now):
    """fresh, stale or expired."""
    return F.when(now - made <= F.expr(f"INTERVAL {FRESH} SECONDS"), "fresh").when(now - made <= F.expr(f"INTERVAL {USABLE} SECONDS"), "stale").otherwise("expired")


def still_valid(kept_head, head, kept_files, files, age):
    """Whether a cached result still holds: same commit and same changed files or, without a commit, an age of USABLE seconds at most."""
    return F.when(head.isNotNull(), kept_head.eqNullSafe(head) & kept_files.eqNullSafe(files)).otherwise(age <= USABLE)


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its last state."""
    kept: dict[str, DataFrame] = {}

    def keep(batch: DataFrame, _: int) -> None:
        kept["last"] = materialize(batch, "stream")

    running = stream.writeStream.outputMode(mode).trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    return kept["last"] if kept else stream.sparkSession.createDataFrame([], stream.schema)


def _expiring(ttl: float) -> Callable:
    """Each key's rows come in order; from one that is let through the next is searched, not awaited."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, free, started = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            times = np.asarray(pc.cast(batch.column(1), pa.timestamp("us"))).astype("datetime64[us]").astype(np.int64)
            codes = batch.column(0).dictionary_encode()
            cuts = [0, *(np.nonzero(np.diff(np.asarray(codes.indices.fill_null(-1))))[0] + 1).tolist(), batch.num_rows]
            keep = np.zeros(batch.num_rows, dtype=bool)
            for a, b in itertools.pairwise(cuts):
                own = batch.column(0)[a].as_py()
                if started and own != key:
                    free = None
                key, started = own, True
                at = a if free is None else a + int(np.searchsorted(times[a:b], free))
                while at < b:
                    keep[at] = True
                    free = times[at] + int(ttl * 1_000_000)
                    at = a + int(np.searchsorted(times[a:b], free))
            yield batch.filter(pa.array(keep))

    return run


def expire(rows: DataFrame, key: str, ts: str, ttl: float, also: list[str]) -> DataFrame:
    """Rows whose key was last emitted ``ttl`` seconds ago or more; what is suppressed doesn't extend the wait. A key's rows stream past in order."""
    own = rows.select(key, ts, *also)
    dealt = own.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, ts, *also)
    return dealt.mapInArrow(_expiring(ttl), own.schema)


def expire_stream(rows: DataFrame, key: str, ts: str, ttl: float) -> DataFrame:
    """The same over a stream, with the last emission of each key as state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        every = pd.concat(list(frames)).sort_values(ts)
        kept = []
        for moment in every[ts]:
            kept.append(last is None or moment - last >= datetime.timedelta(seconds=ttl))
            if kept[-1]:
                last = moment.to_pydatetime()
        state.update((last,))
        yield every.loc[kept, [key, ts]]

    kinds = dict(rows.dtypes)
    return rows.select(key, ts).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {ts} timestamp", "last timestamp", "append", "NoTimeout")
