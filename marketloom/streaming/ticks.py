"""Streaming jobs on ticks and quotes.

Every job writes below the shared folder with a checkpoint, so it restarts from where it stopped. Batch outputs are
addressed by batch id and overwritten on replay, which makes ``foreachBatch`` sinks idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketloom import spec
from marketloom.functions import numeric as N
from marketloom.plans import intraday as D
from marketloom.plans import screener as X
from marketloom.session import settle

TIERS = {"realtime": "30 seconds", "short": "5 minutes", "daily": "1 day", "weekly": "7 days"}


def tick_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Ticks arriving as files; the schema is read once from the files present."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.parquet(folder)
    volume = F.get_json_object("props", "$.k").try_cast("bigint")
    return raw.select(
        F.lit("sh").alias("market"), F.col("event_type").alias("symbol"), "user_id", "event_id", F.to_date("ts").alias("trading_day"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), volume.alias("volume"),
        N.scaled(F.col("value") * volume * 100.0, 2).alias("amount_cents"))


def start(rows: DataFrame, path: str, batch: Callable[[DataFrame, int], None], interval: str | None = None, mode: str = "append") -> StreamingQuery:
    """Run ``batch`` on every micro-batch; without an interval the job drains what is there and stops."""
    writer = rows.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{path}/_checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def drain(query: StreamingQuery) -> None:
    """Wait until all that is there has been processed; a failure of the query is raised."""
    query.awaitTermination()


def realtime_screener(quotes: DataFrame, static: DataFrame, path: str, *, interval: str | None = "30 seconds", conditions: dict | None = None) -> StreamingQuery:
    """Evaluate the tail-session conditions on each micro-batch's newest quote per symbol against static data.

    Symbols without static data keep their row; conditions that cannot be evaluated fail.
    """

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("market", "symbol").agg(F.max_by(F.struct(*[c for c in batch.columns if c not in ("market", "symbol")]), F.struct("quote_time", "event_id")).alias("q"))
        rows = newest.select("market", "symbol", "q.*").join(static, ["market", "symbol"], "left")
        X.tail_session_flags(rows, conditions).write.mode("overwrite").parquet(f"{path}/flags/batch={batch_id}")

    return start(quotes, path, evaluate, interval)


def screener_result(spark: SparkSession, path: str) -> DataFrame:
    """The verdict on each symbol's newest quote over all batches."""
    rows = spark.read.parquet(f"{path}/flags").drop("batch")
    fields = [c for c in rows.columns if c not in ("market", "symbol")]
    return rows.groupBy("market", "symbol").agg(F.max_by(F.struct(*fields), F.struct("quote_time", "event_id")).alias("q")).select("market", "symbol", "q.*")


KEPT_DAYS = 30


def vwap_state(
    ticks: DataFrame, path: str, *, interval: str | None = None, min_ratio_pct: float = 80.0, max_breach_pct: float = 0.3, kept_days: int = KEPT_DAYS,
) -> StreamingQuery:
    """Cumulative VWAP strength per symbol and day, right for late ticks and ticks out of order.

    The state of a (symbol, day) cell is one row: totals, counts and its newest tick. A batch whose ticks follow a cell's newest one adds to
    that row, so it costs what the batch holds; a cell that gets an earlier tick is worked out again from its kept points. State and points of days
    more than ``kept_days`` before the newest day seen are dropped; their results stay, later ticks for them are not counted.
    Everything is addressed by batch: a batch that runs again starts from the state before it.
    """
    cell = list(D.CELL)
    newest = F.max(F.struct("ts", "event_id"))

    def folders(spark: SparkSession, name: str) -> dict[str, object]:
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        return {s.getPath().getName(): s.getPath() for s in fs.listStatus(root)} if fs.exists(root) else {}

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        points = D.usable_points(batch).withColumn("batch", F.lit(batch_id))
        before = [int(n.split("=")[1]) for n in folders(spark, "state") if n.startswith("batch=") and int(n.split("=")[1]) < batch_id]
        shape = "market string, symbol string, trading_day date, valid_points bigint, above_count bigint, breached boolean, cents bigint, volume bigint, last struct<ts: timestamp, event_id: bigint>"
        state = spark.read.schema(shape).parquet(f"{path}/state/batch={max(before)}") if before else spark.createDataFrame([], shape)
        points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trading_day", "batch").parquet(f"{path}/points")
        days = sorted(n.split("=")[1] for n in folders(spark, "points") if n.startswith("trading_day="))
        if not days:
            return
        stored = spark.read.schema(points.schema).parquet(f"{path}/points").where(F.col("batch") <= batch_id)
        horizon = F.date_sub(F.lit(days[-1]).cast("date"), kept_days)
        fresh = stored.where((F.col("batch") == batch_id) & (F.col("trading_day") >= horizon))
        live = state.where(F.col("trading_day") >= horizon)
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        no = lambda c: F.coalesce(F.col(c), F.lit(False))
        totals = [F.sum("amount_cents").alias("cents"), F.sum("volume").alias("volume"), newest.alias("last")]

        def counted(some: DataFrame, base: DataFrame | None = None) -> DataFrame:
            counts = D.point_counts(D.cumulative_vwap(some, base), max_breach_pct)
            return some.groupBy(*cell).agg(*totals).join(counts, cell, "left")

        if not before:  # every cell is new
            changed = settle(counted(fresh).select(*cell, zero("valid_points").cast("bigint").alias("valid_points"), zero("above_count").cast("bigint").alias("above_count"), no("breached").alias("breached"),
                                                    "cents", "volume", "last"))
            D.with_verdict(changed.where("valid_points > 0"), min_ratio_pct).drop("cents", "volume", "last").write.mode("overwrite").parquet(f"{path}/cells/batch={batch_id}")
            changed.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
            return
        touched = fresh.groupBy(*cell).agg(F.min(F.struct("ts", "event_id")).alias("first")).join(live, cell, "left")
        touched = settle(touched.withColumn("late", F.col("last").isNotNull() & (F.col("first") <= F.col("last"))))
        late = touched.where("late").select(*cell)
        ahead = touched.where("NOT late")
        base = ahead.select(*cell, F.coalesce("cents", F.lit(0)).alias("base_cents"), F.coalesce("volume", F.lit(0)).alias("base_volume"))
        add = counted(fresh.join(ahead.select(*cell), cell, "left_semi"), base).alias("n").join(ahead.select(*cell, *[
            F.col(c).alias(f"_{c}") for c in ("valid_points", "above_count", "breached", "cents", "volume")]), cell)
        added = add.select(
            *cell, *[(zero(c) + zero(f"_{c}")).cast("bigint").alias(c) for c in ("valid_points", "above_count")], (no("breached") | no("_breached")).alias("breached"),
            *[(zero(c) + zero(f"_{c}")).cast("bigint").alias(c) for c in ("cents", "volume")], "last")
        changed = added
        if not late.isEmpty():
            again = counted(stored.where(F.col("trading_day") >= horizon).join(late, cell, "left_semi"))
            changed = added.unionByName(again.select(*cell, zero("valid_points").alias("valid_points"), zero("above_count").alias("above_count"), no("breached").alias("breached"), "cents", "volume", "last"))
        changed = settle(changed)
        D.with_verdict(changed.where("valid_points > 0"), min_ratio_pct).drop("cents", "volume", "last").write.mode("overwrite").parquet(f"{path}/cells/batch={batch_id}")
        live.join(touched.select(*cell), cell, "left_anti").unionByName(changed).write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
        drop_before(spark, days[-1], batch_id)

    def drop_before(spark: SparkSession, last_day: str, batch_id: int) -> None:
        """Points of ended days, and states that no rerun can need."""
        import datetime

        ended = str(datetime.date.fromisoformat(last_day) - datetime.timedelta(days=kept_days))
        gone = [p for n, p in folders(spark, "points").items() if n.startswith("trading_day=") and n.split("=")[1] < ended]
        gone += [p for n, p in folders(spark, "state").items() if n.startswith("batch=") and int(n.split("=")[1]) < batch_id - 1]
        for place in gone:
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return start(ticks, path, fold, interval)


def vwap_result(spark: SparkSession, path: str) -> DataFrame:
    """Each cell as its newest batch left it."""
    rows = spark.read.parquet(f"{path}/cells")
    fields = [c for c in rows.columns if c not in (*D.CELL, "batch")]
    return rows.groupBy(*D.CELL).agg(F.max_by(F.struct(*fields), "batch").alias("v")).select(*D.CELL, "v.*")


def window_volume(ticks: DataFrame, path: str, *, delay: str = "2 days", interval: str | None = None) -> StreamingQuery:
    """Volume per symbol, day and named time-of-day window: changed rows per batch, windows still open included.

    The day is an event-time window, so the watermark clears a day's state ``delay`` after its end.
    """
    at = D.clock(F.col("ts"))
    hits = F.filter(F.array(*[F.when(at.between(f"{a}:00", f"{b}:00"), F.lit(n)) for n, a, b in spec.WINDOW_SPECS]), lambda x: x.isNotNull())
    inside = ticks.withWatermark("ts", delay).select("market", "symbol", "ts", "volume", "amount_cents", F.explode(hits).alias("indicator_name"))
    rows = inside.groupBy("market", "symbol", "indicator_name", F.window("ts", "1 day")).agg(
        F.sum("volume").alias("volume_sum"), F.sum("amount_cents").alias("amount_cents"), F.count(F.lit(1)).alias("bar_count"))
    flat = rows.select("market", "symbol", F.to_date("window.start").alias("trading_day"), "indicator_name", "volume_sum", "amount_cents", "bar_count")
    return start(flat, path, lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/windows/batch={i}"), interval, mode="update")


def window_result(spark: SparkSession, path: str) -> DataFrame:
    """Each window as its newest batch left it."""
    key = ("market", "symbol", "trading_day", "indicator_name")
    newest = spark.read.parquet(f"{path}/windows").groupBy(*key).agg(F.max_by(F.struct("volume_sum", "amount_cents", "bar_count"), "batch").alias("v"))
    return newest.select(*key, "v.volume_sum", (F.col("v.amount_cents") / 100.0).alias("amount_sum"), "v.bar_count")


def provisional_days(ticks: DataFrame, path: str, *, delay: str = "2 days", interval: str | None = None) -> StreamingQuery:
    """Running totals of each symbol's day while it trades: changed rows per batch, newest batch wins on reading.

    The day is an event-time window: ``delay`` after its end the watermark drops its state, and later ticks are left to the recompute.
    """
    rows = ticks.withWatermark("ts", delay).groupBy("market", "symbol", F.window("ts", "1 day")).agg(
        F.sum("volume").alias("volume"), F.sum("amount_cents").alias("amount_cents"), F.max("ts").alias("as_of"))
    rows = rows.select("market", "symbol", F.to_date("window.start").alias("trading_day"), "volume", "amount_cents", "as_of")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/provisional/batch={batch_id}")

    return start(rows, path, store, interval, mode="update")


def replace_with_final(spark: SparkSession, path: str, final_days: DataFrame) -> DataFrame:
    """After the close the batch recompute, which has all late ticks, replaces provisional rows of the same day."""
    changes = spark.read.parquet(f"{path}/provisional")
    newest = changes.groupBy("market", "symbol", "trading_day").agg(F.max_by(F.struct("volume", "amount_cents"), "batch").alias("v"))
    provisional = newest.select("market", "symbol", "trading_day", "v.volume", "v.amount_cents")
    return D.splice(final_days, provisional)


def start_tiers(ticks: DataFrame, path: str, batches: dict[str, Callable[[DataFrame, int], None]], *, drain_only: bool = False) -> list[StreamingQuery]:
    """One query per freshness tier, each with its own trigger interval and checkpoint."""
    return [start(ticks, f"{path}/{tier}", fn, None if drain_only else TIERS[tier]) for tier, fn in batches.items()]
