"""Streaming forms: application state, duplicate deliveries, cadence."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.applications import step
from .runs import started

_OUT = "applicationId long, us long, seq long, action string, status string, accepted boolean, late boolean"
DAY = 86_400_000
#: Rows whose state one partition holds, on disk, before there are more partitions than cores.
STATE_ROWS = 500_000


class InOrder(StatefulProcessor):
    """Holds an application's events until no earlier one can come, and applies them by (ts, seq).

    Events up to ``horizon``, the watermark and ``slack`` milliseconds, are settled: later arrivals of them are late."""

    def __init__(self, slack: int):
        self.slack = slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string")
        self.held = handle.getListState("held", "us long, seq long, action string")

    def _now(self) -> str:
        return self.status.get()[0] if self.status.exists() else "saved"

    def _wait(self, held: list[tuple]) -> None:
        """A timer for the earliest event that is held."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer(max(-(-min(held)[0] // 1000) - self.slack, 1))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        settled = (timerValues.getCurrentWatermarkInMs() + self.slack) * 1000 if timerValues.getCurrentWatermarkInMs() > 0 else None
        new = []
        for r in rows:
            if r["us"] is None or settled is not None and r["us"] <= settled:
                yield Row(applicationId=key[0], us=r["us"], seq=r["seq"], action=r["action"], status=self._now(), accepted=False, late=True)
            else:
                new.append((r["us"], r["seq"], r["action"]))
        if new:
            self.held.appendList(new)
            self._wait([tuple(h) for h in self.held.get()])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        settled = (timerValues.getCurrentWatermarkInMs() + self.slack) * 1000
        held = sorted((tuple(h) for h in self.held.get()), key=lambda h: (h[0], h[1] is not None, h[1] or 0))
        status = self._now()
        for us, seq, action in held:
            if us <= settled:
                status, ok = step(status, action)
                yield Row(applicationId=key[0], us=us, seq=seq, action=action, status=status, accepted=ok, late=False)
        self.status.update((status,))
        rest = [h for h in held if h[0] > settled]
        self.held.put(rest) if rest else self.held.clear()
        self._wait(rest)

    def close(self) -> None:
        pass


def stream_applications(events: DataFrame, delay: int = DAY, keep: int = 30 * DAY) -> DataFrame:
    """events(applicationId, ts, seq, action) -> every event with the status after it, in order of (ts, seq) whatever
    order they arrive in, as far as they come within ``delay`` milliseconds of the latest. Later ones are listed as late
    and not applied, those without a time too; the stream drops what comes more than ``keep`` after. Keyed state stands
    for the version check; it holds the status and the events of the last ``delay``."""
    e = events.select("applicationId", F.col("ts").cast("timestamp").alias("ts"), "seq", "action").withColumn("us", F.unix_micros("ts"))
    return e.withWatermark("ts", f"{keep} milliseconds").groupBy("applicationId").transformWithState(InOrder(keep - delay), _OUT, "Append", "EventTime")


def interval_leg(events: DataFrame, kind: str, within: str, delay: str) -> DataFrame:
    """events(user, item, kind, ts) -> (user, item, s, o): saves with each event of ``kind`` that follows within the
    interval, or one row with a null o if none does. Both sides' state goes when the watermark has passed the interval.
    Events of kind ``end`` only move the watermark. Their keys are not null, and are filtered from what the stream wrote: a
    filter on the stream would be pushed below the watermarks, as is that for keys of the inner side."""
    saves = events.where("kind IN ('save', 'end')").select("user", "item", F.col("ts").alias("s")).withWatermark("s", delay)
    others = events.where(F.col("kind").isin(kind, "end")).select(F.col("user").alias("_u"), F.col("item").alias("_i"), F.col("ts").alias("o")).withWatermark("o", delay)
    return saves.join(others, F.expr(f"user = _u AND item = _i AND o >= s AND o <= s + INTERVAL {within}"), "leftOuter").select("user", "item", "s", "o")


def funnel_of_legs(undone: DataFrame, drafted: DataFrame) -> DataFrame:
    """The funnel of what the two legs (save with undo within a day, with draft within seven) have told so far."""
    of = lambda leg, name: leg.groupBy("user", "item").agg(F.min("s").alias(f"s_{name}"), F.min_by("o", F.struct("s", F.col("o").isNull())).alias(name))
    j = of(undone, "u").join(of(drafted, "d").hint("merge"), ["user", "item"]).where("s_u = s_d")
    return j.agg(F.count(F.lit(1)).alias("saved"), F.count_if(F.col("u").isNull()).alias("useful"), F.count_if(F.col("d").isNotNull()).alias("drafted"))


def state_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for the state of so many rows: a store is opened and committed in every batch, however little it holds,
    so there are as many as cores, more where each would hold over STATE_ROWS, but no more than a shuffle has."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS)))


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """What a stream yields for the input that is there now, written under ``out``: a folder for each batch, or the last
    state for complete output. A batch that is run again writes its own folder again."""
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else n}")

    started(stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True), partitions=partitions).awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/batch=*")


def dedupe_deliveries(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """The first delivery of each key within the watermark's delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def cadence_counts(df: DataFrame, at: str, slot: str = "6 hours") -> DataFrame:
    """(slot, items) for every slot between the first and the last, empty ones with 0."""
    t = F.col(at).cast("timestamp")
    counts = df.groupBy(F.window(t, slot).alias("w")).agg(F.count(F.lit(1)).alias("items")).select(F.col("w.start").alias("slot"), "items")
    span = counts.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).where("a IS NOT NULL")
    slots = span.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {slot}"))).alias("slot"))
    return slots.join(counts.hint("merge"), "slot", "left").select("slot", F.coalesce("items", F.lit(0)).alias("items"))


def stream_cadence(stream: DataFrame, at: str, slot: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, slot)).agg(F.count(F.lit(1)).alias("items"))
