"""The application state machine over event tables, and owners' lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored

# States in order, user actions (state before, state after) and system transitions.
STATES = ("saved", "package_ready", "awaiting_approval", "approved", "queued", "actor_running", "submitted", "needs_user", "failed")
ACTIONS = {"package_ready": ("saved", "package_ready"), "request_approval": ("package_ready", "awaiting_approval"), "approve": ("awaiting_approval", "approved")}
SYSTEM = {"queued": ("approved", "needs_user", "failed"), "actor_running": ("queued",), "submitted": ("actor_running",), "needs_user": ("actor_running",), "failed": ("actor_running",)}
#: Action -> (state after, states before).
MOVES = {a: (after, (before,)) for a, (before, after) in ACTIONS.items()} | {f"system:{s}": (s, before) for s, before in SYSTEM.items()}
INVALID = "INVALID_APPLICATION_TRANSITION"


def step(state: str, action: str) -> tuple[str, bool]:
    """(state after, accepted): an action whose state is already reached changes nothing."""
    after, before = MOVES.get(action, (None, ()))
    if after is not None and (state == after or state in before):
        return after, True
    return state, False


#: Events that one task folds alone, and chunks whose maps one task puts together; both powers of two.
CHUNK, FAN = 1024, 1024


def _reached() -> Column:
    """Action -> the state that it leads to from each state, -1 where it may not happen."""
    rows = [F.array(*(F.lit(STATES.index(after) if s == after or s in before else -1) for s in STATES)) for after, before in MOVES.values()]
    return F.create_map(*(x for a, row in zip(MOVES, rows) for x in (F.lit(a), row)))


def _composed(chunks: Column) -> Column:
    """The state after chunks (id, m) from each state before."""
    same = F.array(*(F.lit(i) for i in range(len(STATES))))
    return F.aggregate(chunks, same, lambda acc, c: F.transform(acc, lambda s: c["m"][s]))


def _walked(chunks: Column, start: Column) -> Column:
    """(id, the state before it) of chunks (id, m) in order."""
    zero = F.struct(start.cast("int").alias("st"), F.array().cast("array<struct<id:bigint,start:int>>").alias("out"))
    return F.aggregate(chunks, zero, lambda acc, c: F.struct(c["m"][acc["st"]].alias("st"), F.concat(acc["out"], F.array(F.struct(c["id"].alias("id"), acc["st"].alias("start")))).alias("out")))["out"]


def _starts(maps: DataFrame) -> DataFrame:
    """maps(app, id, m) -> (app, id, start): the state before each chunk, by a prefix over spans of FAN chunks and over
    the chunks of each span."""
    listed = F.sort_array(F.collect_list(F.struct("id", "m"))).alias("c")
    spans = maps.groupBy("app", F.floor(F.col("id") / FAN).alias("span")).agg(listed)
    tops = spans.select("app", "span", F.struct(F.col("span").alias("id"), _composed(F.col("c")).alias("m")).alias("x")).groupBy("app").agg(F.sort_array(F.collect_list("x")).alias("t"))
    tops = tops.select("app", F.explode(_walked(F.col("t"), F.lit(0))).alias("w")).select("app", F.col("w.id").alias("span"), "w.start")
    return spans.join(tops.hint("merge"), ["app", "span"]).select("app", F.explode(_walked(F.col("c"), F.col("start"))).alias("w")).select("app", "w.id", "w.start")


def fold_applications(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events(applicationId, action, ts, seq) -> (state (applicationId, status, approvedAt, updatedAt, n_rejected),
    rejected (applicationId, seq, action, status, code)); every application starts as saved.

    An action maps each state to the state after it, and maps compose; so an application's events, sorted over range
    partitions, are folded in chunks of CHUNK, each from all states at once, and a prefix over the chunks' maps tells
    the state that each began in. No list holds more than CHUNK events or FAN maps, but that of an application's spans of
    CHUNK * FAN events. Null ids are an application of their own; null times come first.
    """
    app = F.coalesce(F.col("applicationId").cast("string"), F.lit("")).alias("app")
    e = events.select(F.col("applicationId").alias("id_"), F.concat(F.col("applicationId").isNull().cast("int").cast("string"), app).alias("app"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("seq").cast("bigint").alias("seq"), "action")
    order = ["app", "ts", "seq"]
    e = stored(e.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "app-events")
    none = F.array(*[F.lit(-1)] * len(STATES))
    one = F.struct("at", "ts", "seq", "action", F.coalesce(F.element_at(_reached(), F.col("action")), none).alias("to"))
    chunks = e.groupBy("app", F.floor(F.col("at") / CHUNK).alias("id")).agg(F.first("id_").alias("id_"), F.sort_array(F.collect_list(one)).alias("e"))
    zero = F.array(*(F.struct(F.lit(i).alias("st"), F.lit(0).cast("bigint").alias("rej"), F.lit(None).cast("timestamp_ntz").alias("ok"), F.lit(None).cast("timestamp_ntz").alias("up")) for i in range(len(STATES))))

    def step_all(acc, x):
        def moved(a):
            to = x["to"][a["st"]]
            new = (to >= 0) & (to != a["st"])
            return F.struct(F.when(to >= 0, to).otherwise(a["st"]).alias("st"), (a["rej"] + (to < 0).cast("bigint")).alias("rej"), F.when(new & (to == STATES.index("approved")), x["ts"]).otherwise(a["ok"]).alias("ok"), F.when(new, x["ts"]).otherwise(a["up"]).alias("up"))

        return F.transform(acc, moved)

    chunks = stored(chunks.withColumn("r", F.aggregate("e", zero, step_all)), "app-chunks")
    starts = stored(_starts(chunks.select("app", "id", F.transform("r", lambda a: a["st"]).alias("m"))), "app-starts")
    j = chunks.join(starts.hint("merge"), ["app", "id"]).withColumn("r", F.element_at("r", F.col("start") + 1))
    last = lambda c: F.max_by(f"r.{c}", F.when(F.col(f"r.{c}").isNotNull(), F.col("id")))
    done = j.groupBy("app").agg(F.first("id_").alias("applicationId"), F.max_by("r.st", "id").alias("st"), last("ok").alias("approvedAt"), last("up").alias("updatedAt"), F.sum("r.rej").cast("int").alias("n_rejected"))
    state = done.select("applicationId", F.element_at(F.array(*map(F.lit, STATES)), F.col("st") + 1).alias("status"), "approvedAt", "updatedAt", "n_rejected")

    def judge(acc, x):
        to = x["to"][acc["st"]]
        bad = F.array(F.struct(x["seq"].alias("seq"), x["action"].alias("action"), acc["st"].alias("st")))
        return F.struct(F.when(to >= 0, to).otherwise(acc["st"]).alias("st"), F.when(to < 0, F.concat(acc["bad"], bad)).otherwise(acc["bad"]).alias("bad"))

    begin = F.struct(F.col("start").alias("st"), F.array().cast("array<struct<seq:bigint,action:string,st:int>>").alias("bad"))
    bad = j.where("r.rej > 0").select(F.col("id_").alias("applicationId"), F.explode(F.aggregate("e", begin, judge)["bad"]).alias("b"))
    return state, bad.select("applicationId", "b.seq", "b.action", F.element_at(F.array(*map(F.lit, STATES)), F.col("b.st") + 1).alias("status"), F.lit(INVALID).alias("code"))


def list_applications(applications: DataFrame, session: str, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(an owner's applications, newest first, at most ``most``; the exact total)."""
    own = applications.where(F.col("sessionHash") == session)
    return own.orderBy(F.desc("savedAt"), "applicationId").limit(most), own.agg(F.count(F.lit(1)).alias("total"))
