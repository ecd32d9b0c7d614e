"""Streaming forms of the live queries, run over the events table as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from embergrid.operators import live as batch
from embergrid.plans import adapters
from embergrid.session import child_names, materialize, scratch_path
from embergrid.streaming import files as feed_files, live as stream_live, state
from embergrid.streaming.sink import latest, run_available, run_measured


def _source(w) -> DataFrame:
    schema = adapters.read(w.spark, w.dir, "events").schema
    return adapters.as_feed(w.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(w.dir))


def _final(rows: DataFrame) -> DataFrame:
    return latest(rows, "d", "yi", "xi")


def cell_days(w) -> DataFrame:
    stream = stream_live.cell_days(stream_live.cleaned(_source(w), w.cfg))
    return _final(run_available(stream, "update", "stream-days")[0])


def deduplicated(w) -> DataFrame:
    """Every detection is sent twice; each counts once."""
    twice = _source(w).unionByName(_source(w))
    once = stream_live.deduplicated(stream_live.cleaned(twice, w.cfg))
    kept = run_available(once.select("ts", "yi", "xi", "frp"), "append", "stream-dedupe")[0]
    return kept.groupBy(F.col("ts").cast("date").alias("d"), "yi", "xi").agg(
        F.count(F.lit(1)).alias("n"), F.sum("frp").alias("frp")
    )


def masked(w) -> DataFrame:
    mask = materialize(w.static.select("yi", "xi").distinct(), "mask")
    stream = stream_live.cell_days(stream_live.masked(stream_live.cleaned(_source(w), w.cfg), mask))
    return _final(run_available(stream, "update", "stream-mask")[0])


def rolling(w) -> DataFrame:
    """Sliding sums out of the stream's state, weeks that are not over included."""
    stream = stream_live.week_counts(stream_live.cleaned(_source(w), w.cfg))
    return latest(run_available(stream, "update", "stream-weeks")[0], "first_day", "yi", "xi")


def complete_weeks(w) -> DataFrame:
    """Append mode: a week appears once the watermark (two days late) has passed its end."""
    stream = stream_live.complete_weeks(stream_live.cleaned(_source(w), w.cfg, "2 days"))
    return run_available(stream, "append", "stream-complete-weeks")[0].drop("batch")


def complete(w) -> DataFrame:
    """Append mode: a day appears once the watermark (two days late) has passed its end."""
    stream = stream_live.cell_days(stream_live.cleaned(_source(w), w.cfg, "2 days"))
    return run_available(stream, "append", "stream-complete")[0].drop("batch")


def nowcast(w, home: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """After every micro-batch the feed's last 168 hours are ranked against past years.

    The window slides with the newest day seen; it is one table, which each batch replaces. No event at all: no row.
    """
    spark = w.spark
    home = home or scratch_path(spark, "nowcast")
    ranks = f"{home}/ranks"
    series, static = w.series, materialize(w.static, "static")
    stream = stream_live.cell_days(stream_live.cleaned(_source(w) if source is None else source, w.base))

    def rank(current: DataFrame) -> DataFrame:
        now = batch.nowcast_now(current, w.links(current), static, w.areas)
        return batch.nowcast_rank(now, batch.nowcast_history(current, series, w.cfg), w.cfg)

    def step(rows: DataFrame, number: int) -> None:
        window = state.advance(f"{home}/window", rows, number, adapters.FEED_HOURS // 24)
        if window is not None:
            rank(window).write.mode("overwrite").parquet(f"{ranks}/last")

    nothing = spark.createDataFrame([], "d date, yi int, xi int, n bigint, frp double")
    if not child_names(spark, ranks):
        rank(nothing).write.mode("overwrite").parquet(f"{ranks}/last")
    run_available(stream, "update", "stream-nowcast", step, home=home)
    return spark.read.parquet(f"{ranks}/last")


ARRIVALS = 4  # parts in which the events come


def arrivals(w) -> DataFrame:
    """Events as they come in ``ARRIVALS`` parts: by day, but some a part late, some with the last part only, and some sent
    again with the next part."""
    feed = adapters.as_feed(adapters.read(w.spark, w.dir, "events"))
    span = feed.agg(F.min("acq_date").alias("first"), (F.datediff(F.max("acq_date"), F.min("acq_date")) + 1).alias("len"))
    dated = feed.join(F.broadcast(span), F.col("len") > 0)  # one row
    by_day = F.floor(F.datediff("acq_date", "first") * ARRIVALS / F.col("len")).cast("int")
    last = ARRIVALS - 1
    part = F.when(F.col("det_id") % 11 == 5, last).when(F.col("det_id") % 7 == 3, F.least(by_day + 1, F.lit(last))).otherwise(by_day)
    again = F.when((F.col("det_id") % 13 == 1) & (F.col("part") < last), F.array("part", F.col("part") + 1)).otherwise(F.array("part"))
    return dated.withColumn("part", part).withColumn("part", F.explode(again)).drop("first", "len")


def late_data(w) -> DataFrame:
    """(arrival, rows, late, repeated, added): what became of each part's usable detections; two days late are accepted.

    The stream stops after each part and goes on with the next one.
    """
    spark, home = w.spark, scratch_path(w.spark, "stream-late")
    sent = materialize(arrivals(w), "arrivals")
    landing = f"{home}/landing"
    metrics = None
    for part in range(ARRIVALS):
        sent.filter(F.col("part") == part).drop("part").write.parquet(f"{landing}/part={part}")
        source = spark.readStream.schema(sent.drop("part").schema).parquet(f"{landing}/part=*")
        cleaned = stream_live.measured(stream_live.cleaned(source, w.cfg, "2 days"))
        once = stream_live.deduplicated(cleaned).select("det_id", "ts", "yi", "xi", "frp")
        _, metrics = run_measured(once, "append", "stream-late", home=f"{home}/stream")
    order = Window.orderBy("batch")  # one row per batch
    return metrics.select((F.row_number().over(order) - 1).alias("arrival"), "rows", "late", "repeated", "added")


def refeed(w) -> DataFrame:
    """Cell-days of feed files of which some are sent again, unchanged, under another name: each content counts once."""
    spark, home = w.spark, scratch_path(w.spark, "stream-files")
    text = w.feed.select(
        "acq_date", F.lpad(F.col("hhmm").cast("string"), 4, "0").alias("acq_time"), "latitude", "longitude", "confidence", "frp"
    )
    columns = {"first": text.columns, "again": text.columns, "more": text.columns[::-1]}
    early = F.col("acq_date") < F.date_sub(F.lit(w.today), 3)
    for name, part in (("first", text.filter(early)), ("again", text.filter(early)), ("more", text.filter(~early))):
        # the same rows in the same order make the same files
        dealt = part.repartition(4, "acq_date").sortWithinPartitions(*text.columns)
        dealt.select(*columns[name]).write.option("header", True).csv(f"{home}/landing/{name}")
        rows = feed_files.feed_rows(feed_files.new_files(spark, f"{home}/landing"))
        kept, _ = run_available(rows, "append", "stream-files", home=f"{home}/stream")
    return batch.live_cell_days(kept, w.base)
