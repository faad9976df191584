"""Toxicity: a counterfactual-regularised word classifier.

Words (and stems of longer words) that are commoner in toxic than in other labelled documents, counted over all labelled
rows, form the vocabulary together with the identity terms: all words of the fitting sample whose ratio has a lower
confidence bound of at least ``LEAST_RATIO``, which doesn't rise with the size of the table. A word outside the sample
would get no weight. A logistic model over their presence is fitted on
a bounded sample of labelled documents (``FIT_DOCS``, by hash of the id). Each sampled document is also an example with
a neutral sentence about a group after it, a template filled with one of the identity terms, under the document's own
label. Every example that mentions identity terms, or words with the stem of one, has a copy in which each such word is
swapped for another term of its group in the same language, with the stem of that term, and squared differences between
the scores of the two are penalised, so a neutral mention of a group doesn't move the score.

Defined results: null and empty texts have no words and get the base score; without labelled rows the score is 0.5;
a document labelled more than once counts once with its least label; repeated rows are scored alike; null doc_ids are
scored and never train; of labelled rows that repeat an id one text is fitted on; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import LETTERS_APART, mix, slices, span_hashes, words
from .quality import HELD_OUT, one_label
from .shared import small_or_merge, written

#: Documents the weights are fitted on at most; bytes of a stem.
FIT_DOCS, STEM = 20_000, 7
#: Least lower bound of a vocabulary word's ratio, and standard errors below it; weight of the counterfactual and the plain penalty.
LEAST_RATIO, ERRORS, FAIR, SHRINK = 1.5, 1.645, 1.0, 3e-4

# Identity terms by language, kind of word and group, and neutral sentences for each kind of word.
IDENTITY = {
    "en": {
        "plural": (("women", "men"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("immigrants", "refugees", "foreigners", "natives")),
        "noun": (("woman", "man"),),
        "adjective": (
            ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino", "arab", "african", "european"),
            ("gay", "lesbian", "bisexual", "transgender", "straight", "heterosexual", "homosexual", "queer"), ("disabled", "blind", "deaf"),
        ),
    },
    "fr": {
        "plural": (("femmes", "hommes"), ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées"), ("immigrés", "réfugiés", "étrangers")),
        "noun": (("femme", "homme"),),
        "adjective": (
            ("musulman", "chrétien", "juif", "bouddhiste", "athée"), ("noir", "blanc", "asiatique", "arabe", "africain", "européen"), ("gai", "lesbienne", "bisexuel", "transgenre", "hétérosexuel"), ("handicapé", "aveugle", "sourd"),
        ),
    },
    "de": {
        "plural": (("frauen", "männer"), ("muslime", "christen", "juden", "buddhisten", "atheisten"), ("einwanderer", "flüchtlinge", "ausländer")),
        "noun": (("frau", "mann"),),
        "adjective": (
            ("muslimisch", "christlich", "jüdisch", "buddhistisch", "atheistisch"), ("schwarz", "weiß", "asiatisch", "arabisch", "afrikanisch", "europäisch"), ("schwul", "lesbisch", "bisexuell", "heterosexuell"), ("behindert", "gehörlos"),
        ),
    },
    "es": {
        "plural": (("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos", "budistas", "ateos"), ("inmigrantes", "refugiados", "extranjeros")),
        "noun": (("mujer", "hombre"),),
        "adjective": (("musulmán", "cristiano", "judío", "budista", "ateo"), ("negro", "asiático", "árabe", "africano", "europeo"), ("gay", "lesbiana", "bisexual", "heterosexual"), ("discapacitado", "ciego", "sordo")),
    },
}
TEMPLATES = {
    "en": {"plural": ("many {} live in this town", "we spoke with {} about their day", "a group of {} met for lunch"), "noun": ("a {} lives next door", "we met a {} at the station"), "adjective": ("a {} person lives next door", "my {} friend came for lunch", "the {} teacher read to us")},
    "fr": {"plural": ("beaucoup de {} vivent dans cette ville", "nous avons parlé avec des {} hier"), "noun": ("chaque {} a sa place", "voici {} et enfant"), "adjective": ("mon voisin est {}", "quelqu'un de {} est venu hier")},
    "de": {"plural": ("viele {} wohnen in dieser stadt", "wir sprachen gestern mit {} darüber"), "noun": ("{} und kind gingen vorbei", "hier wohnt {} mit hund"), "adjective": ("mein nachbar ist {}", "eine freundin von uns ist {}")},
    "es": {"plural": ("muchos {} viven en esta ciudad", "hablamos ayer con {} de su día"), "noun": ("cada {} tiene su sitio", "aquí viven {} e hijo"), "adjective": ("mi vecino es {}", "alguien {} vino ayer")},
}
_U = np.uint64
_STEMS = _U(0x5EED)


def word_hash(term: str) -> int:
    b = np.frombuffer(term.encode(), np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]))[0])


def stem_hash(term: str) -> int:
    """Hash of the stem that a term emits; 0 if it is too short for one."""
    b = np.frombuffer(term.encode(), np.uint8)
    return int(mix(span_hashes(b, np.array([0]), np.array([STEM])) ^ _STEMS)[0]) if len(b) > STEM else 0


def _pairs() -> Iterator[tuple[str, str]]:
    """Each identity term with the term of its group and language that it is swapped for."""
    for kinds in IDENTITY.values():
        for groups in kinds.values():
            for group in groups:
                yield from zip(group, (*group[1:], group[0]))


def _table(of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes ``of`` the terms, and word and stem hash of what each is swapped for; the first pair of a hash counts."""
    first: dict[int, tuple[int, int]] = {}
    for a, b in _pairs():
        first.setdefault(of(a), (word_hash(b), stem_hash(b)))
    first.pop(0, None)
    rows = sorted((a, *b) for a, b in first.items())
    a, b, st = zip(*rows)
    return np.array(a, _U), np.array(b, _U), np.array(st, _U)


def _swaps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _table(word_hash)


def _stem_swaps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _table(stem_hash)


def mentions() -> list[str]:
    """The neutral sentences with every term of their language and kind in place."""
    return [t.replace("{}", term) for lang, kinds in IDENTITY.items() for kind, groups in kinds.items() for t in TEMPLATES[lang][kind] for group in groups for term in group]


def _hashed(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each word, its hash, hash of its stem or 0) of row ranges."""
    for first, data, off in slices(texts):
        s, e, row = words(data, off, LETTERS_APART)
        h = span_hashes(data, s, e) if len(s) else np.zeros(0, _U)
        st = np.zeros(len(s), _U)
        long = np.flatnonzero(e - s > STEM)
        if len(long):
            st[long] = mix(span_hashes(data, s[long], s[long] + STEM) ^ _STEMS)
        yield first, len(off) - 1, row, h, st


def _distinct(h: np.ndarray, st: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([h, st[st != 0]]))


def features_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct hashes of the words and stems) of every text."""
    for first, n, row, h, st in _hashed(texts):
        at = np.searchsorted(row, np.arange(n + 1))
        for r in range(n):
            yield first + r, _distinct(h[at[r] : at[r + 1]], st[at[r] : at[r + 1]])


def counterfactuals_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Features of every text and of its copy with the identity terms swapped; None where it has none."""
    by_word, by_stem = _swaps(), _stem_swaps()
    for _, n, row, h, st in _hashed(texts):
        to_h, to_st, hit = h.copy(), st.copy(), np.zeros(len(h), bool)
        for (a, b, b_st), of in ((by_stem, st), (by_word, h)):  # the term itself goes before its stem
            i = np.minimum(np.searchsorted(a, of), len(a) - 1)
            found = a[i] == of
            to_h[found], to_st[found] = b[i[found]], b_st[i[found]]
            hit |= found
        at = np.searchsorted(row, np.arange(n + 1))
        for r in range(n):
            x = slice(at[r], at[r + 1])
            yield _distinct(h[x], st[x]), _distinct(to_h[x], to_st[x]) if hit[x].any() else None


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label, picked = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        found = list(features_of(batch.column(0)))
        lens = [len(u) for _, u in found]
        h = np.concatenate([u for _, u in found]) if found else np.zeros(0, _U)
        y, at = (np.repeat(c[[r for r, _ in found]] if found else np.zeros(0, int), lens) for c in (label, picked))
        key, inv = np.unique(h, return_inverse=True)
        bad = np.bincount(inv, weights=y, minlength=len(key)).astype(np.int64)
        n = np.bincount(inv, minlength=len(key))
        seen = np.bincount(inv, weights=at, minlength=len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(bad), pa.array(n - bad), pa.array(seen)], names=["h", "bad", "good", "seen"])


def active(u: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Places in the sorted vocabulary of the hashes that it holds."""
    i = np.minimum(np.searchsorted(vocab, u), len(vocab) - 1)
    return i[vocab[i] == u]


def _examples(vocab: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = list(counterfactuals_of(pa.array(mentions())))
        for batch in batches:
            ys, xs, fair = [], [], []
            picks = batch.column(2).to_pylist()
            for (u, swapped), y, pick in zip(counterfactuals_of(batch.column(0)), batch.column(1).to_pylist(), picks):
                neutral, other = said[pick % len(said)]
                after = u if swapped is None else swapped
                for x, f in ((u, swapped), (np.union1d(u, neutral), np.union1d(after, other))):
                    ys.append(y)
                    xs.append(active(x, vocab).astype(np.int32))
                    fair.append(None if f is None else active(f, vocab).astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(xs, kind), pa.array(fair, kind)], names=["label", "x", "fair"])

    return run


class Sparse:
    """Binary rows by their places: products with weights, and sums of places by row values."""

    def __init__(self, rows: pa.ListArray, width: int):
        self.n, self.width = len(rows), width
        self.at = rows.flatten().to_numpy()
        self.row = np.repeat(np.arange(self.n), rows.value_lengths().to_numpy())

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.row], minlength=self.width)


def fit_weights(x, fair, y: np.ndarray, width: int, steps: int = 400, rate: float = 0.1, fairness: float = FAIR) -> tuple[np.ndarray, float]:
    """Weights and constant of the penalised logistic model (Adam over all examples); x and fair list places by row."""
    x, fair = (c if isinstance(c, pa.Array) else pa.array(c, pa.list_(pa.int32())) for c in (x, fair))
    all_x, pairs = Sparse(x, width), fair.is_valid()
    left, right = Sparse(x.filter(pairs), width), Sparse(fair.filter(pairs), width)
    w = np.zeros(width + 1)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for c in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(all_x.dot(w[:-1]) + w[-1], -30, 30)))
        g = np.append(all_x.back((p - y) / len(y)) + SHRINK * w[:-1], (p - y).mean())
        if left.n and fairness:
            d = left.dot(w[:-1]) - right.dot(w[:-1])
            g[:-1] += 2 * fairness * (left.back(d) - right.back(d)) / left.n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**c)) / (np.sqrt(v / (1 - 0.99**c)) + 1e-8)
    return w[:-1], float(w[-1])


def _scores(vocab: np.ndarray, w: np.ndarray | None, constant: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if w is None:
                p = np.full(batch.num_rows, 0.5)
            else:
                z = np.array([w[active(u, vocab)].sum() for _, u in features_of(batch.column(1))]) + constant
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train_where: str, fairness: float = FAIR) -> tuple[np.ndarray, np.ndarray | None, float]:
    """(vocabulary hashes, weights or None without labelled rows, constant)."""
    label = written(one_label(labels, "toxic").where(train_where), "train-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_or_merge(label), "doc_id").select("text", "label", "doc_id")
    total, bad = texts.agg(F.count(F.lit(1)), F.sum("label")).first()
    vocab = np.unique(_swaps()[0])
    if not total:
        return vocab, None, 0.0
    bad, good = int(bad), int(total - bad)
    # the sample is chosen among the labels, so that no text moves
    some = F.broadcast(label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS).select("doc_id", F.lit(1).alias("picked")))
    marked = texts.join(some, "doc_id", "left").select("text", "label", F.coalesce("picked", F.lit(0)).alias("picked"))
    counts = marked.mapInArrow(_counts, "h long, bad long, good long, seen long").groupBy("h").agg(*(F.sum(c).alias(c) for c in ("bad", "good", "seen"))).where("bad >= 2 and seen > 0")
    p, q = (F.col("bad") + 0.5) / (bad + 1), (F.col("good") + 0.5) / (good + 1)
    error = F.sqrt(1 / (F.col("bad") + 0.5) - 1 / (bad + 1) + 1 / (F.col("good") + 0.5) - 1 / (good + 1))
    found = counts.where(F.log(p / q) - ERRORS * error >= float(np.log(LEAST_RATIO))).select("h").toArrow()
    vocab = np.unique(np.concatenate([vocab, found.column(0).to_numpy().view(_U)]))
    sample = texts.join(some, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("label").alias("label"))
    picked = sample.select("text", F.col("label").cast("int").alias("label"), (F.xxhash64("text") % (1 << 31) + (1 << 31)).alias("pick"))
    rows = picked.mapInArrow(_examples(vocab), "label int, x array<int>, fair array<int>").toArrow()
    x, fair, y = (rows[c].combine_chunks() for c in ("x", "fair", "label"))
    w, c = fit_weights(x, fair, y.to_numpy().astype(float), len(vocab), fairness=fairness)
    return vocab, w, c


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_where: str = f"not ({HELD_OUT})") -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, toxic) -> (doc_id, held_out, score, predicted), a row per row of docs."""
    vocab, w, c = fit(docs, labels, train_where)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(vocab, w, c), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
