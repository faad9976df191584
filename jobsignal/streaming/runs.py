"""Ingestion of crawl runs that arrive in pieces: staged items, run assembly by state and timers, merge, ledger."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import lookups, normalize, reports
from ..plans.stored import dropped, hadoop_path, small_or_merge, stored
from ..sources import store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_JOIN_FORMAT = "spark.sql.streaming.join.stateFormatVersion"
RUN = "actor_id string, run_status string, dataset_id string, total long"
_RECEIPT = f"run_id string, batch long, {RUN}, items long, at timestamp"
#: How far apart the clocks may be that receipts are stamped by.
SKEW = "10 minutes"
_ASSEMBLED = f"run_id string, {RUN}, collected long, batches string, outcome string"


def started(query, provider: str = ROCKSDB, partitions: int | None = None):
    """A stream writer started with a state store that has timers, list and map state, and keeps a join's state in one
    store a partition, not four; in so many partitions, if given, of which a checkpoint keeps the first number."""
    conf = query._spark.conf
    wanted = {_PROVIDER: provider, _JOIN_FORMAT: "3" if provider == ROCKSDB else conf.get(_JOIN_FORMAT)}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        return query.start()
    finally:
        for k, v in before.items():
            conf.set(k, v)


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


# first step: items to the staging table


def stage_items(stream: DataFrame, root: str, checkpoint: str, at: str | None = None):
    """stream(run_id, actor_id, run_status, dataset_id, total, item, payload) to ``root``: a batch's items in one folder,
    and a receipt for each run in it. ``total`` is the run's number of items as its pages tell; a row with a null item
    is a manifest, which tells nothing else. A batch that is run again overwrites its folders. ``at`` stands for the clock's time."""

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        batch.where("item IS NOT NULL").select("run_id", "item", "payload").sortWithinPartitions("run_id").write.mode("overwrite").parquet(f"{root}/items/batch={n}")
        told = [F.max(c).alias(c) for c in ("actor_id", "run_status", "dataset_id", "total")]
        receipts = batch.groupBy("run_id").agg(*told, F.count("item").alias("items")).select("run_id", F.lit(n).cast("long").alias("batch"), "actor_id", "run_status", "dataset_id", "total", "items", (F.lit(at).cast("timestamp") if at else F.current_timestamp()).alias("at"))
        receipts.write.mode("overwrite").parquet(f"{root}/receipts/{n}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


# second step: receipts to whole runs


class Assembler(StatefulProcessor):
    """Of each run: its receipts by batch, what they tell of it, and how many items it was last passed on with.

    A run is passed on when its receipts sum to its total (``whole``), again when more come (``reopened``), or, once, when
    nothing has come for ``patience`` milliseconds and items are missing (``expired``), by the clock of the receipts: as
    later ones of other runs show. Receipts that are delivered twice count once."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", RUN)
        self.receipts = handle.getMapState("receipts", "batch long", "items long")
        self.passed = handle.getValueState("passed", "items long")

    def _row(self, key: tuple, outcome: str) -> Row:
        sizes = {k[0]: v[0] for k, v in self.receipts.iterator()}
        return Row(run_id=key[0], **dict(zip(("actor_id", "run_status", "dataset_id", "total"), self.told.get())), collected=sum(sizes.values()), batches=",".join(map(str, sorted(sizes))), outcome=outcome)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        told = self.told.get() if self.told.exists() else (None,) * 4
        last = 0
        for r in rows:
            last = max(last, int(r["at"].timestamp() * 1000))
            self.receipts.updateValue((r["batch"],), (r["items"],))
            told = tuple(told[i] if r[c] is None else r[c] for i, c in enumerate(("actor_id", "run_status", "dataset_id", "total")))
        self.told.update(told)
        row = self._row(key, "whole")
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        before = self.passed.get()[0] if self.passed.exists() else None
        if told[3] is not None and row["collected"] >= told[3]:
            if before != row["collected"]:
                self.passed.update((row["collected"],))
                yield row if before is None else Row(**(row.asDict() | {"outcome": "reopened"}))
        else:
            self.handle.registerTimer(last + self.patience)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._row(key, "expired")

    def close(self) -> None:
        pass


def assembled_runs(spark: SparkSession, root: str, patience: int = 86_400_000, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the runs staged under ``root`` that are whole, reopened or expired. State and shuffle hold receipts,
    a row for a run and batch, so that a run of any size takes a few bytes for each batch it came in."""
    receipts = spark.readStream.schema(_RECEIPT).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).parquet(f"{root}/receipts")
    return receipts.withWatermark("at", SKEW).groupBy("run_id").transformWithState(Assembler(patience), _ASSEMBLED, "Append", "EventTime")


# third step: whole runs to the target table and the ledger


#: Rows of a part that one task writes, about.
PIECE_ROWS = 20_000


class Target:
    """A table in parts by hash of the key, each in the version of the batch that last changed it; a pointer per batch
    names the versions. A batch writes the parts that its keys fall into; parts double when they hold more than
    ``part_rows`` rows on average, a batch's all counted as new, which rewrites all of them that once."""

    def __init__(self, spark: SparkSession, path: str, key: str, part_rows: int = 1_000_000):
        self.spark, self.path, self.key, self.part_rows = spark, path, key, part_rows

    def part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(parts)).cast("int").alias("part")

    def layout(self, n: int) -> dict[int, tuple[int, int]]:
        """(version, rows) of each part after batch n, empty parts included; batches that merge nothing have no pointer."""
        root, fs = hadoop_path(self.spark, f"{self.path}-pointer")
        done = [int(f.getPath().getName().removeprefix("batch=")) for f in fs.listStatus(root)] if fs.exists(root) else []
        for b in sorted((b for b in done if b <= n), reverse=True):
            if _exists(self.spark, f"{self.path}-pointer/batch={b}/_SUCCESS"):
                return {r.part: (r.version, r.rows) for r in self.spark.read.parquet(f"{self.path}-pointer/batch={b}").collect()}  # a row a part
        return {}

    def rows(self, layout: dict[int, tuple[int, int]], schema) -> DataFrame:
        paths = [f"{self.path}/version={v}/part={p}" for p, (v, rows) in sorted(layout.items()) if rows]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, new: DataFrame, n: int, schema, order: str) -> None:
        """The rows of batch n over the table after batch n - 1."""
        before = self.layout(n - 1)
        size, parts = sum(r for _, r in before.values()) + new.count(), len(before) or 1
        while size > parts * self.part_rows:
            parts *= 2
        touched = range(parts) if parts != len(before) else [r.part for r in new.select(self.part(parts)).distinct().collect()]  # a row a part
        old = before if parts != len(before) else {p: before[p] for p in touched}
        merged = store.upsert_postings(self.rows(old, schema), new, self.key, order)[0]
        piece = F.pmod(F.xxhash64(self.key, F.lit("piece")), F.lit(-(-size // (parts * PIECE_ROWS)) or 1))  # a part of many rows is written by several tasks
        merged.withColumn("part", self.part(parts)).repartition("part", piece).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/version={n}")
        wrote = self.spark.read.schema(f"{self.key} {dict(new.dtypes)[self.key]}, part int").parquet(f"{self.path}/version={n}").groupBy("part").count().collect() if size else []
        after = {p: v for p, v in before.items() if parts == len(before)} | {p: (n, 0) for p in touched} | {r.part: (n, r["count"]) for r in wrote}
        self.spark.createDataFrame([(p, *v) for p, v in sorted(after.items())], "part int, version int, rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}-pointer/batch={n}")

    def latest(self, schema) -> DataFrame:
        return self.rows(self.layout(1 << 62), schema)


LEDGER = "run_id string, seq long, status string, finished_at timestamp, collected long, accepted long, rejected long, indexed long, failed long, error string"


def _ledger(spark: SparkSession, target: Target) -> DataFrame:
    path = f"{target.path}-ledger"
    return spark.read.schema(LEDGER).option("basePath", path).parquet(f"{path}/batch=*") if _exists(spark, path) else spark.createDataFrame([], LEDGER)


def read_ledger(spark: SparkSession, target: Target) -> DataFrame:
    """The latest row of each run."""
    return store.ledger_state(_ledger(spark, target))


def ingest_runs(assembled: DataFrame, root: str, target: Target, allowed: DataFrame, order: str, now: str, checkpoint: str, schema):
    """assembled_runs -> jobs merged into the target, and ledger rows.

    Each batch: runs are verified, and those that the ledger has as complete are skipped unless they were reopened; a row
    says that the rest have begun; their items are read from the batches that their receipts name, each item once, the
    latest delivery of it; runs with fewer different items than they should have stay open (``partial``); the others'
    are normalized, jobs are merged, the report goes to the ledger. Expired runs are ``failed``. A batch that is run
    again overwrites its own folders, so deliveries may repeat.
    """
    spark = assembled.sparkSession
    ledger_path = f"{target.path}-ledger"

    def ingest(batch: DataFrame, n: int) -> None:
        runs = stored(batch.withColumnRenamed("run_status", "status"), "runs")
        if runs.isEmpty():  # a batch that only moved the watermark
            dropped(runs)
            return
        judged = stored(lookups.verify_runs(runs, allowed), "judged-runs")
        late = judged.where("outcome = 'expired'")
        known = store.ledger_state(_ledger(spark, target).where(F.col("seq") < 3 * n))
        ready = judged.where("reason IS NULL AND outcome <> 'expired'")
        new = store.plan_runs(ready.where("outcome = 'whole'"), known)
        asked = stored(new.unionByName(ready.where("outcome = 'reopened'")).select("run_id", "total", "batches"), "asked-runs")
        refused = store.failed_rows(judged.where("reason IS NOT NULL AND outcome <> 'expired'"), 3 * n + 1, now, "not verified")
        refused = refused.unionByName(store.failed_rows(late, 3 * n + 1, now, "items missing"))
        if asked.isEmpty():
            refused.write.mode("overwrite").parquet(f"{ledger_path}/batch={n}/step=ended")
            for t in (runs, judged, asked):
                dropped(t)
            return
        store.started_rows(asked, 3 * n, now).write.mode("overwrite").parquet(f"{ledger_path}/batch={n}/step=started")
        named = [r.b for r in asked.select(F.explode(F.split("batches", ",")).alias("b")).distinct().collect()]  # a row a staged batch
        staged = spark.read.schema("run_id string, item long, payload string, batch int").option("basePath", f"{root}/items").parquet(*(f"{root}/items/batch={b}" for b in named))
        mine = staged.join(small_or_merge(asked.select("run_id")), "run_id", "left_semi")
        items = stored(mine.groupBy("run_id", "item").agg(F.max_by("payload", "batch").alias("payload")), "items")
        found = items.groupBy("run_id").agg(F.count(F.lit(1)).alias("found"))
        sized = stored(asked.join(found.hint("merge"), "run_id", "left").select("run_id", "total", F.coalesce("found", F.lit(0)).alias("found")), "sized-runs")
        fine = sized.where("found >= total").select("run_id")
        waiting = store.started_rows(sized.where("found < total"), 3 * n + 1, now)
        if fine.isEmpty():
            refused.unionByName(waiting).write.mode("overwrite").parquet(f"{ledger_path}/batch={n}/step=ended")
            for t in (runs, judged, asked, items, sized):
                dropped(t)
            return
        raw = items.join(small_or_merge(fine), "run_id", "left_semi").select(F.struct("run_id", "item").alias("at"), "payload")
        jobs = stored(normalize.judge_postings(raw, "stream", now, "at").withColumn("sourceRunId", F.col("item.run_id")).withColumn(order, F.col("item.item")), "judged-items")
        target.merge(jobs.where("code IS NULL").select(*schema.names, order), n, schema, order)
        of = lambda df: df.select(F.col("item.run_id").alias("run_id"), F.col("item.item").alias("index"), "code")
        report = reports.run_report(fine, of(jobs.where("code IS NULL")), of(jobs.where("code IS NOT NULL")), of(jobs).limit(0))
        store.ended_rows(report, 3 * n + 1, now).unionByName(refused).unionByName(waiting).write.mode("overwrite").parquet(f"{ledger_path}/batch={n}/step=ended")
        for t in (runs, judged, asked, items, sized, jobs):
            dropped(t)

    return assembled.writeStream.foreachBatch(ingest).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stream_ingest(stream: DataFrame, root: str, target: Target, allowed: DataFrame, order: str, now: str, schema, patience: int = 86_400_000, at: str | None = None) -> None:
    """What the stream holds now, staged, assembled and ingested; runs that lack items wait for a later call."""
    stage_items(stream, root, f"{root}/checkpoints/stage", at).start().awaitTermination()
    if _exists(stream.sparkSession, f"{root}/receipts"):
        started(ingest_runs(assembled_runs(stream.sparkSession, root, patience), root, target, allowed, order, now, f"{root}/checkpoints/ingest", schema)).awaitTermination()
