"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled good; unlabelled text is a sample of all documents that are not held out, whatever
their labels, which are not looked at. The class prior is estimated from the two: a first model tells positives from
unlabelled text, and the share of unlabelled text among the best scores, against that of positives there, bounds the prior
(the best cut after a correction for the sizes of both samples). The risk is then minimised with that prior. Labelled
negatives take no part in either step; the labels of both kinds only set the curve from the model's output to a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_blocks, with_columns

#: Labelled rows, and rows of unlabelled text, to learn from, at most: those with the smallest hashes of their ids.
MAX_LABELLED = MAX_UNLABELLED = 20_000
BINS = 12
THRESHOLD = 0.7
UNLABELLED = -1

_CLASSES = [
    [*range(65, 91)], [*range(97, 123)], [*range(48, 58)], [32], [10], [9, 11, 12, 13], [*range(128, 256)],
    list(b"."), list(b","), list(b"!"), list(b"?"), list(b"|"), list(b"#"), list(b"$"), list(b"%"), list(b"&"), list(b"*"),
    list(b"<>"), list(b"{}[]()"), list(b"\"'`"), list(b"=+-_/\\~^"), list(b":;"), list(b"@"),
]
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES):
    _CLASS_OF[_members, _k] = 1


def features(text: str) -> list[float]:
    """Shares of character classes, lengths, repetition of words and compressibility of a whole text."""
    raw = text.encode()
    if not raw:
        return [0.0] * (len(_CLASSES) + 11)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS_OF / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    lower = shares[1] + shares[0] + 1e-9
    return [
        *shares.tolist(),
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / n, len(set(words)) / n, again / n,
        len(zlib.compress(raw, 1)) / len(raw), np.log1p(len(raw) / len(lines)), len(set(lines)) / len(lines), shares[0] / lower,
        max(map(len, lines)) / len(raw), np.log1p(max(map(len, words), default=0)),
    ]


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def minimise(slope, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Weights after so many Adam steps along a risk's slope."""
    w, m, v = np.zeros(size, np.float32), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = slope(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def best_cut(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The class prior from scores of held-back positives and unlabelled rows: above a cut where hardly a negative is
    found, the unlabelled rows number as many as the prior's share of the positives. The cut is the one of the smallest
    upper bound at that doubt."""
    cuts = np.sort(np.concatenate((positive, unlabelled)))
    p, u = (1 - np.searchsorted(np.sort(x), cuts) / len(x) for x in (positive, unlabelled))
    slack = np.sqrt(np.log(4 / doubt) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    p, u = p[p > 0.02], u[p > 0.02]
    at = ((u + slack) / p).argmin()
    return float(min(1.0, u[at] / p[at]))


def estimate_prior(p: np.ndarray, u: np.ndarray, steps: int = 150, ridge: float = 1e-2) -> float:
    """Two models of positives against unlabelled rows, each scoring the half that it has not seen."""
    half_p, half_u = np.arange(len(p)) % 2, np.arange(len(u)) % 2
    scores = np.empty(len(p)), np.empty(len(u))
    for h in (0, 1):
        a, b = p[half_p != h], u[half_u != h]
        if not len(a) or not len(b):
            return 0.5
        w = minimise(lambda w: b.T @ _sigmoid(b @ w) / len(b) - a.T @ _sigmoid(-(a @ w)) / len(a) + ridge * w, p.shape[1], steps)  # noqa: B023
        scores[0][half_p == h], scores[1][half_u == h] = p[half_p == h] @ w, u[half_u == h] @ w
    return best_cut(*scores)


class Model:
    """An additive model over binned and plain features, with a calibrated output."""

    def __init__(self, prior: float):
        self.prior, self.weights = prior, None
        self.a, self.b = 1.0, 0.0

    def basis(self, x: np.ndarray) -> np.ndarray:
        bins = (x[:, :, None] > self.edges[None]).reshape(len(x), -1)
        plain = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.concatenate((np.ones((len(x), 1)), plain, bins), axis=1, dtype=np.float32)

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300, ridge: float = 1e-2) -> Model:
        """Minimise the non-negative risk of positives and unlabelled rows under the estimated prior. The ridge is wider for
        few positives."""
        ridge = ridge + 5 / len(positive)
        self.mean, self.scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-9
        self.edges = np.quantile(unlabelled, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        p, u = self.basis(positive), self.basis(unlabelled)
        self.prior = prior = estimate_prior(p, u)

        def slope(w: np.ndarray) -> np.ndarray:
            gp, gu = p @ w, u @ w
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            down = u.T @ _sigmoid(gu) / len(u) - prior * (p.T @ _sigmoid(gp)) / len(p)
            # the non-negative correction: step back from an impossible negative risk
            return -down if negative < 0 else down - prior * (p.T @ _sigmoid(-gp)) / len(p) + ridge * w

        self.weights = minimise(slope, p.shape[1], steps)
        return self

    def calibrate(self, g: np.ndarray, label: np.ndarray) -> Model:
        """A logistic curve from the model's output to the share of label 1; it stays as it is without both labels."""
        if label.all() or not label.any():
            return self
        a, b = 1.0, 0.0
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a * g + b, -30, 30)))
            s, e = q * (1 - q) + 1e-9, q - label
            h = np.array([[(s * g * g).sum() + 1e-2, (s * g).sum()], [(s * g).sum(), s.sum() + 1e-2]])
            a, b = np.array([a, b]) - np.linalg.solve(h, [(e * g).sum() + 1e-2 * (a - 1), e.sum() + 1e-2 * b])
        self.a, self.b = (a, b) if 0 < a < 100 else (1.0, 0.0)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        # in double precision, so that a score does not depend on which rows are scored together
        return _sigmoid(self.a * (self.basis(x).astype(np.float64) @ self.weights.astype(np.float64)) + self.b)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches, 0):
        x = pa.array([features(t) for t in block.column(0).to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([block.column(1), x], names=["label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learn from at most ``max_labelled`` labelled rows and ``max_unlabelled`` rows of unlabelled text, none of them held
    out. Rows without id are left out, as are labels that are neither 0 nor 1. Null texts are empty ones; rows that repeat
    an id all count; columns other than those named are not looked at. Without positives or without documents every text
    scores the share of label 1, or 1 if there are no labels at all."""
    known = labels.select(F.col(id_col).cast("long").alias("_m_label_id"), F.col(label_col).cast("int").alias("label")).filter("_m_label_id is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("_m_label_id"))).orderBy(F.xxhash64("_m_label_id"), "_m_label_id", "label").limit(max_labelled)
    id_, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    some = docs.select(id_.alias("_m_label_id")).filter(F.col("_m_label_id").isNotNull() & ~held_out(F.col("_m_label_id")))
    some = some.distinct().orderBy(F.xxhash64("_m_label_id", F.lit("unlabelled")), "_m_label_id").limit(max_unlabelled).withColumn("label", F.lit(UNLABELLED))
    wanted = F.broadcast(known.unionByName(some))  # no more rows than both bounds
    rows = docs.select(id_.alias("_m_id"), text.alias("_m_text")).join(wanted, F.col("_m_id") == F.col("_m_label_id"))
    got = rows.select("_m_text", "label").mapInArrow(_feature_rows, "label int, x array<double>").toPandas()
    if not len(got):
        return Model(1.0)
    x, label = np.array(got["x"].tolist()), got["label"].to_numpy()
    order = np.lexsort((*x.T, label))  # the same sums whatever the order of rows
    x, label = x[order], label[order]
    marked = label != UNLABELLED
    if not (label == 1).any():
        return Model(0.0 if marked.any() else 1.0)
    model = Model(1.0).fit(x[label == 1], x[~marked])
    return model.calibrate(model.basis(x[marked]) @ model.weights, label[marked])


def _scorer(model, kept: int | None):
    """Texts are the first column, or the one of that number, which is then passed on as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if kept is not None:
            batches = (b.add_column(0, "_m_text", b.column(kept)) for b in batches)
        for block in text_blocks(batches, 0):
            scores = model.value.score(np.array([features(t) for t in block.column(0).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*block.columns[1:], pa.array(scores)], names=[*block.schema.names[1:], "_m_score"])

    return run


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on). Null texts are scored as empty ones, rows with
    null or repeated ids like any other; output columns replace input columns of the same name; an empty table gives an
    empty result. Only the text enters a score. There is no shuffle; the model's size does not depend on the data."""
    spark = docs.sparkSession
    rest = [c for c in docs.columns if keep_text or c != text_col]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*rest).schema.fields)
    kept = rest.index(text_col) if (text_col, "string") in docs.select(*rest).dtypes else None  # then the text travels once
    sent = docs.select(*rest) if kept is not None else docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_m_text"), *rest)
    out = sent.mapInArrow(_scorer(spark.sparkContext.broadcast(model), kept), f"{fields}_m_score double")
    return with_columns(out, score=F.col("_m_score"), predicted=(F.col("_m_score") >= threshold).cast("int")).drop("_m_score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep_text=False).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
