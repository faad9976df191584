"""Streams over several files and batches."""

import json

import pytest
from pyspark.sql import functions as F

from jobsignal.catalog import texts
from jobsignal.operators import applications, planned
from jobsignal.plans import stored
from jobsignal.sources import paged
from jobsignal.streaming import apps, runs

NOW = "2026-07-31 00:00:00"
JOB = "jobId string, title string, sourceRunId string, contentHash string, description string"
ITEMS = f"run_id string, {runs.RUN}, item long, payload string"


@pytest.fixture(autouse=True)
def one_partition(spark):
    """State in one partition: these streams hold some dozen rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def payload(run, item, title="Engineer"):
    posting = {"title": title, "description": f"Text of {item}", "hiringOrganization": {"name": "Acme"}, "identifier": {"value": f"{run}-{item}"}}
    return json.dumps({"sourceUrl": f"https://jobs.example.com/{run}/{item}", "jobPosting": posting})


class Feed:
    def __init__(self, spark, tmp_path, patience=86_400_000):
        self.spark, self.path, self.n, self.patience = spark, f"file://{tmp_path}", 0, patience
        self.schema = spark.createDataFrame([], JOB).schema
        self.target = runs.Target(spark, f"{self.path}/target", "jobId", part_rows=8)

    def put(self, *rows):
        """A file of items (run, item, total[, title])."""
        self.n += 1
        made = [(r, "crawler" if r != "other" else "other", "SUCCEEDED", "ds", total, item, None if item is None else payload(r, item, *title)) for r, item, total, *title in rows]
        self.spark.createDataFrame(made, ITEMS).coalesce(1).write.parquet(f"{self.path}/in/{self.n}")

    def drain(self, at=None):
        allowed = self.spark.createDataFrame([("crawler",)], "actor_id string")
        stream = self.spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{self.path}/in")
        runs.stream_ingest(stream, f"{self.path}/root", self.target, allowed, "item_index", NOW, self.schema, self.patience, at)

    def jobs(self):
        return {(r.sourceRunId, r.description): r.title for r in self.target.latest(self.schema).collect()}

    def ledger(self):
        return {r.run_id: (r.status, r.collected, r.indexed, r.error) for r in runs.read_ledger(self.spark, self.target).collect()}


def test_run_in_three_files(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put(*[("a", i, 10) for i in range(4)], ("b", 0, 3), ("d", 0, 3), ("d", 1, 3))
    feed.put(*[("a", i, 10) for i in range(4, 8)], ("other", 0, 1), ("d", 0, 3))
    feed.drain()
    # nothing is whole yet: of d three rows have come, but two items
    assert feed.jobs() == {} and feed.ledger() == {"other": ("failed", 0, 0, "not verified"), "d": ("partial", 0, 0, None)}
    feed.put(*[("a", i, 10) for i in range(8, 10)], ("b", 1, None), ("d", 2, 3))
    feed.drain()
    assert {d for r, d in feed.jobs() if r == "a"} == {f"Text of {i}" for i in range(10)} and len(feed.jobs()) == 13 and feed.ledger()["d"] == ("complete", 3, 3, None)
    assert feed.ledger()["a"] == ("complete", 10, 10, None) and "b" not in feed.ledger()
    # late items reopen the run; a manifest alone tells a total; an item that comes again is the later one
    feed.put(("a", 10, 11), ("a", 3, 11, "Engineer II"), ("b", 2, None), ("c", None, 0))
    feed.drain()
    assert feed.ledger() == {"other": ("failed", 0, 0, "not verified"), "a": ("complete", 11, 11, None), "b": ("complete", 3, 3, None), "c": ("complete", 0, 0, None), "d": ("complete", 3, 3, None)}
    assert len(feed.jobs()) == 17 and feed.jobs()["a", "Text of 3"] == "Engineer II"
    assert len(feed.target.layout(1000)) == 4  # parts doubled beyond 8 rows


def test_expired_run(spark, tmp_path):
    feed = Feed(spark, tmp_path, patience=3_600_000)
    feed.put(("a", 0, 3), ("b", 0, 1))
    feed.drain("2026-07-01 00:00:00")
    assert "a" not in feed.ledger()
    feed.put(("other", 0, 1))
    feed.drain("2026-07-01 02:00:00")
    assert feed.ledger()["a"] == ("failed", 0, 0, "items missing") and feed.ledger()["b"][0] == "complete"
    feed.put(("a", 1, 3), ("a", 2, 3))
    feed.drain("2026-07-01 03:00:00")
    assert feed.ledger()["a"] == ("complete", 3, 3, None)


# applications and funnels


def app_events(n, seed, apps=3):
    import datetime
    import random

    rng = random.Random(seed)
    names = [*applications.MOVES, "unknown", None]
    start = datetime.datetime(2024, 1, 1)
    return [(rng.choice([None, *range(apps)]), start + datetime.timedelta(minutes=rng.randrange(5000)), i, rng.choice(names)) for i in range(n)]


EVENTS = "applicationId long, ts timestamp, seq long, action string"


def plain_fold(events):
    state, rejected = {}, []
    for a, ts, seq, action in sorted(events, key=lambda e: (e[1], e[2])):
        status, approved, updated, bad = state.get(a, ("saved", None, None, 0))
        after, ok = applications.step(status, action)
        if not ok:
            rejected.append((a, seq, action, status))
        moved = ok and after != status
        state[a] = (after, ts if moved and after == "approved" else approved, ts if moved else updated, bad + (not ok))
    return state, rejected


@pytest.mark.parametrize("limits", [(1024, 1024), (4, 2)])
def test_fold_in_chunks(spark, monkeypatch, limits):
    monkeypatch.setattr(applications, "CHUNK", limits[0])
    monkeypatch.setattr(applications, "FAN", limits[1])
    events = app_events(300, 1)
    state, rejected = applications.fold_applications(spark.createDataFrame(events, EVENTS).repartition(3))
    want, bad = plain_fold(events)
    assert {r.applicationId: (r.status, r.approvedAt, r.updatedAt, r.n_rejected) for r in state.collect()} == want
    assert sorted((tuple(r)[:4] for r in rejected.collect()), key=lambda r: r[1]) == sorted(bad, key=lambda r: r[1])


def test_one_long_application_is_spread(spark):
    # a hundred thousand events of one application: more than one task folds them
    events = spark.range(100_000, numPartitions=4).select(F.lit(1).alias("applicationId"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), F.element_at(F.array(*map(F.lit, applications.MOVES)), (F.col("id") % len(applications.MOVES) + 1).cast("int")).alias("action"))
    state, _ = applications.fold_applications(events)
    r = state.first()
    status, bad = "saved", 0
    moves = list(applications.MOVES)
    for i in range(100_000):
        status, ok = applications.step(status, moves[i % len(moves)])
        bad += not ok
    assert (r.status, r.n_rejected) == (status, bad)


def files(spark, folder, parts, schema):
    """A file for each part, in order of time."""
    import time

    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
        time.sleep(0.05)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_stream_in_event_time_order(spark, tmp_path):
    import datetime
    import random

    events = [e for e in app_events(120, 7) if e[0] is not None]
    shuffled = random.Random(1).sample(events, len(events))
    end = (None, datetime.datetime(2024, 3, 1), 999, None)
    stream = files(spark, f"file://{tmp_path}/in", [shuffled[:50], shuffled[50:], [end]], EVENTS)
    rows = apps.drain(apps.stream_applications(stream, 5 * apps.DAY, 10 * apps.DAY), f"file://{tmp_path}/out", f"file://{tmp_path}/c").where("applicationId IS NOT NULL").collect()
    want, bad = plain_fold(events)
    last = {}
    for r in sorted(rows, key=lambda r: (r.us, r.seq)):
        last[r.applicationId] = r.status
    assert len(rows) == len(events) and last == {a: s[0] for a, s in want.items()} and sum(not r.accepted for r in rows) == len(bad) and not any(r.late for r in rows)


def test_late_events_are_listed(spark, tmp_path):
    import datetime

    day = lambda n: datetime.datetime(2024, 1, n)
    parts = [[(1, day(10), 1, "package_ready")], [(1, day(20), 2, "approve")], [(1, day(9), 3, "request_approval")], [(1, day(21), 4, "request_approval")], [(None, day(31), 9, None)]]
    stream = files(spark, f"file://{tmp_path}/in", parts, EVENTS)
    rows = {r.seq: (r.status, r.accepted, r.late) for r in apps.drain(apps.stream_applications(stream, apps.DAY, 25 * apps.DAY), f"file://{tmp_path}/out", f"file://{tmp_path}/c").where("applicationId IS NOT NULL").collect()}
    assert rows == {1: ("package_ready", True, False), 2: ("package_ready", False, False), 3: (rows[3][0], False, True), 4: ("awaiting_approval", True, False)}


def test_funnel_of_streams(spark, tmp_path):
    import datetime
    import random

    rng = random.Random(4)
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(500))
    rows = [(rng.randrange(12), rng.randrange(3), rng.choice(["save", "undo", "draft"]), at()) for _ in range(150)]
    schema = "user long, item long, kind string, ts timestamp"
    end = [(-1, -1, "end", datetime.datetime(2024, 6, 1))]
    legs = []
    for kind, within in (("undo", "24 HOURS"), ("draft", "7 DAYS")):
        stream = files(spark, f"file://{tmp_path}/{kind}-in", [rows[:70], rows[70:], end], schema)
        legs.append(apps.drain(apps.interval_leg(stream, kind, within, "30 days"), f"file://{tmp_path}/{kind}", f"file://{tmp_path}/{kind}-c").where("user >= 0"))
    batch = planned.funnel_metrics(spark.createDataFrame(rows, schema))
    assert apps.funnel_of_legs(*legs).first() == batch.first()


def test_paged_items(spark, tmp_path):
    spark.dataSource.register(paged.PagedItems)
    rows = [("a", f"a{i}") for i in range(25)] + [("b", f"b{i}") for i in range(7)]
    spark.createDataFrame(rows, "run string, payload string").repartition(3).write.partitionBy("run").parquet(f"{tmp_path}/runs")
    read = lambda **o: spark.read.format("paged_items").options(**o).load(f"{tmp_path}/runs")
    pages = read(pageSize=4)
    got = sorted((r.run_id, r.item, r.payload) for r in pages.collect())
    assert pages.rdd.getNumPartitions() == 7 + 2 and got == sorted((r.run_id, r.item, r.payload) for r in read(pageSize=10_000).collect())
    assert sorted((r, p) for r, _, p in got) == sorted(rows) and [i for r, i, _ in got if r == "a"] == list(range(25))
    assert read(run="b", pageSize=3).count() == 7
    with pytest.raises(Exception, match="pageSize"):
        read(pageSize=0).count()
    stream = spark.readStream.format("paged_items").option("pageSize", 4).load(f"{tmp_path}/runs")
    out = lambda: apps.drain(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    assert sorted((r.run_id, r.item, r.payload) for r in out().collect()) == got
    spark.createDataFrame([("c", "c0")], "run string, payload string").write.mode("append").partitionBy("run").parquet(f"{tmp_path}/runs")
    assert sorted((r.run_id, r.payload) for r in out().collect()) == sorted([*rows, ("c", "c0")])


def test_funnel_state_follows_rows(spark, sf_dir, monkeypatch):
    """A store for each core, not for each shuffle partition, and one for both sides of the join."""
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    checkpoints, drain = [], apps.drain
    monkeypatch.setattr(apps, "drain", lambda stream, out, checkpoint, **k: checkpoints.append(checkpoint) or drain(stream, out, checkpoint, **k))
    texts.d5_stream_funnel(spark, sf_dir).collect()
    for c in checkpoints:
        path, fs = stored.hadoop_path(spark, f"{c}/state/0")
        parts = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().isdigit()]
        assert len(parts) == spark.sparkContext.defaultParallelism < 24
        assert not fs.exists(stored.hadoop_path(spark, f"{parts[0]}/left-keyToNumValues")[0])
    assert len(checkpoints) == 2 and spark.conf.get("spark.sql.shuffle.partitions") == "24"
    assert apps.state_partitions(spark, 10_000_000) == 20 and apps.state_partitions(spark, 10**9) == 24
