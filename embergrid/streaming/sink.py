"""Run a stream over everything available and keep its output in the shared folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from embergrid.session import scratch_path
from embergrid.streaming.live import FEED_METRICS


def run_available(
    stream: DataFrame, mode: str, label: str, each: Callable[[DataFrame, int], None] | None = None, home: str | None = None
) -> tuple[DataFrame, list[dict]]:
    """(output rows with their batch number, progress reports).

    ``home`` is the stream's own folder for rows and progress: called again with it, the stream goes on where it
    stopped. A repeated batch overwrites its own folder, so a restart after a failure does not count twice. Without
    ``home`` a scratch folder is used and the stream begins anew.
    """
    spark = stream.sparkSession
    base = home or scratch_path(spark, label)
    out = f"{base}/rows"
    schema = stream.schema

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if each is not None:
            each(spark.read.schema(schema).parquet(f"{out}/batch={number}"), number)

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()
    progress = [p if isinstance(p, dict) else p.jsonValue() if hasattr(p, "jsonValue") else dict(p) for p in query.recentProgress]
    # an empty folder of its own makes the output readable before the first batch
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    return spark.read.option("basePath", out).schema(f"{_ddl(stream)}, batch int").parquet(out), progress


BATCHES_KEPT = 10_000  # progress reports a run may have; one is about 2 KB on the driver
METRICS = "batch bigint, rows bigint, newest timestamp, late bigint, repeated bigint, added bigint, watermark timestamp"


def run_measured(stream: DataFrame, mode: str, label: str, metrics: str = FEED_METRICS, home: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(output rows, metrics): ``run_available`` and a table with one row per batch that had input.

    ``stream`` observes ``metrics`` (rows, newest in microseconds) before its deduplication. Of these rows ``late`` came behind the watermark
    and were dropped, ``repeated`` were known already, and ``added`` are new. The table lies in ``home`` beside the rows
    and grows with every run, so it covers stops and restarts; a run that has to repeat a batch replaces that batch's row.
    """
    spark = stream.sparkSession
    base = home or scratch_path(spark, label)
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(BATCHES_KEPT))
    try:
        rows, progress = run_available(stream, mode, label, home=base)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    table = [_measures(p, metrics) for p in progress if p["numInputRows"]]
    name = f"{table[0][0]}-{table[-1][0]}" if table else "none"
    spark.createDataFrame(table, METRICS).write.mode("overwrite").parquet(f"{base}/metrics/run={name}")
    found = spark.read.schema(f"{METRICS}, run string").option("basePath", f"{base}/metrics").parquet(f"{base}/metrics")
    return rows, found.drop("run").dropDuplicates(["batch"])


def _measures(progress: dict, metrics: str) -> tuple:
    seen = progress["observedMetrics"][metrics]
    states = progress["stateOperators"]
    late = sum(s["numRowsDroppedByWatermark"] for s in states)
    repeated = sum(s["customMetrics"].get("numDroppedDuplicateRows", 0) for s in states)
    reached = dt.datetime.fromisoformat(progress["eventTime"]["watermark"].replace("Z", "+00:00"))
    newest = None if seen["newest"] is None else dt.datetime.fromtimestamp(seen["newest"] / 1e6, dt.timezone.utc)
    return progress["batchId"], seen["rows"], newest, late, repeated, seen["rows"] - late - repeated, reached


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Update-mode output -> final rows: the newest version of every key."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
