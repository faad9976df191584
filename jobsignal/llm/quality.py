"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of each whole text are standardised and mapped to cosines that approximate a Gaussian kernel. Every
partition of labelled rows sums its normal equations; the sums are added row by row of the matrix, in two levels so that
no group holds a row of every partition, solved on the driver (its size is fixed by ``N_COSINES``) and give raw scores.
An isotonic fit over counted score bins turns these into probabilities; it rests on a fifth of the labelled rows, by hash
of the id, that the ridge fit leaves out (on all of them if that fifth is empty).

Defined results: null and empty texts have all-zero statistics and get a score like any other; without labelled rows
the score is 0.5; a document labelled more than once counts once with its least label; repeated rows are scored alike;
null doc_ids are scored and never train; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .docstats import FEATURES, feature_rows
from .shared import pieces, plain_named, written

N_COSINES, WIDTH, RIDGE, SCORE_BINS = 256, 6.0, 0.3, 2048
#: Groups of partitions whose sums are added first.
GROUPS = 64
HELD_OUT = "crc32(cast(doc_id as string)) % 4 = 2"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = feature_rows(batch.column(1)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["doc_id", *FEATURES])


def document_features(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, " + ", ".join(f"{f} float" for f in FEATURES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_features, schema)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(f)).to_numpy() for f in FEATURES], 1).astype(float)


class Cosines:
    """x -> sqrt(2 / D) * cos(W x + b) of the standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-6, std, 1.0)
        self.w = rng.standard_normal((len(mean), N_COSINES)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, N_COSINES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        c = np.sqrt(2 / N_COSINES) * np.cos(z @ self.w + self.b)
        return np.concatenate([c, np.ones((len(x), 1))], 1)


def _normal_equations(cosines: Cosines):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = N_COSINES + 1
        total = np.zeros((d, d + 1))
        for batch in batches:
            z = cosines(matrix(batch))
            y = batch.column(batch.schema.get_field_index("label")).to_numpy().astype(float)
            total += z.T @ np.concatenate([z, y[:, None]], 1)
        group = pa.array(np.full(d, TaskContext.get().partitionId() % GROUPS, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), group, pa.array(list(total), pa.list_(pa.float64()))], names=["r", "g", "v"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    total = np.add.reduce([v.values.to_numpy() for v in rows["v"]])
    return pa.table({"r": rows["r"][:1], "v": pa.array([total], pa.list_(pa.float64()))})


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of mean y over sorted x with counts n (pooled adjacent violators)."""
    pools: list[list[float]] = []  # mean, count, sum of x
    for a, b, c in zip(x, y, n):
        pools.append([b / c, c, a * c])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, c2, s = pools.pop()
            p = pools[-1]
            p[0], p[1], p[2] = (p[0] * p[1] + m * c2) / (p[1] + c2), p[1] + c2, p[2] + s
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] for p in pools])


class Model:
    def __init__(self, cosines: Cosines | None, beta: np.ndarray | None):
        self.cosines, self.beta, self.knots = cosines, beta, None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def fit(train: DataFrame) -> Model:
    """train(doc_id, FEATURES..., label) -> model; sums over all its rows."""
    apart = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    stats = train.agg(F.count(F.lit(1)), *(F.avg(f) for f in FEATURES), *(F.stddev_pop(f) for f in FEATURES)).first()
    if not stats[0]:
        return Model(None, None)
    k = len(FEATURES)
    cosines = Cosines(np.array(stats[1 : k + 1], float), np.array(stats[k + 1 :], float))
    parts = train.where(~apart).mapInArrow(_normal_equations(cosines), "r int, g int, v array<double>")
    some = parts.groupBy("r", "g").applyInArrow(_added, "r int, v array<double>")
    rows = some.groupBy("r").applyInArrow(_added, "r int, v array<double>").collect()  # N_COSINES + 1 rows, whatever the input
    g = np.array([x.v for x in sorted(rows, key=lambda x: x.r)])
    ridge = RIDGE * np.eye(len(g))
    ridge[-1, -1] = 1e-6
    model = Model(cosines, np.linalg.solve(g[:, :-1] + ridge, g[:, -1]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = np.clip(np.floor((model.raw(matrix(batch)) + 0.5) / 2 * SCORE_BINS), 0, SCORE_BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(b), batch.column(batch.schema.get_field_index("label"))], names=["bin", "label"])

    def counted(rows: DataFrame) -> list[tuple]:
        bins = rows.mapInArrow(binned, "bin int, label int").groupBy("bin").agg(F.sum("label").alias("y"), F.count(F.lit(1)).alias("n")).collect()
        return sorted((b.bin, b.y, b.n) for b in bins)  # at most SCORE_BINS rows

    bins = counted(train.where(apart)) or counted(train)
    x, y, n = (np.array(c, float) for c in zip(*bins))
    model.knots = isotonic((x + 0.5) / SCORE_BINS * 2 - 0.5, y, n)
    return model


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch)))], names=["doc_id", "score"])

    return run


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) once for each labelled document."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(column).cast("int")).alias("label"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_where: str = f"not ({HELD_OUT})") -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality) -> (doc_id, held_out, score, predicted), a row per row of docs."""
    feats = written(document_features(docs), "features")
    train = feats.join(one_label(labels, "quality").where(train_where).hint("merge"), "doc_id")
    model = fit(written(train, "train"))
    out = feats.mapInArrow(_scores(model), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with their columns."""
    train = document_features(docs).join(one_label(labels, "quality").where(f"not ({HELD_OUT})").hint("merge"), "doc_id")
    model = fit(written(train, "train"))
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ok = model.score(feature_rows(batch.column(names.index("text"))).astype(np.float32).astype(float)) >= threshold
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(ok)).columns, names=names)

    return plain_named(docs).mapInArrow(kept, docs.schema)
