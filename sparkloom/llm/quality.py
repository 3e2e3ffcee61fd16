"""Document quality by a regularised quadratic discriminant.

Each document becomes a vector of transformed statistics of its whole text (never its language, source or id).
For each class the labelled vectors give a mean and a covariance, by sums that Spark adds up over all training
rows; the covariances shrink towards the pooled one and its diagonal. A score is the logistic function of the
difference of the two log-densities plus the log prior ratio; the Mahalanobis terms come from Cholesky factors that are made
once and shipped with the scoring function.

Defined results: null and empty texts have all-zero counts and are scored like any other; repeated rows each get
a row; of several labels of a document the least counts; null labels and labels without a document are ignored;
very long texts count whole; an empty table gives no rows; other columns are ignored by the query and kept by ``accepted``.
With fewer than two rows of a class, every score is the share of class 1 (0.5 without labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import as_bytes, forget, keep, pieces, released, small_enough, table

THRESHOLD = 0.3
#: Shrinkage of the class covariances to the pooled one, and then to its diagonal.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.1, 0.1, 1e-3
#: Bounds of the logistic function's argument, so that scores stay within (0, 1).
MOST_LOGIT = 30.0
#: Statistics are rounded to multiples of 1 / UNIT. Bits of the lower part of a product of two.
UNIT, PART = 1 << 20, 25

N_STATS = 16
_UPPER, _LOWER, _DIGIT = (slice(ord(a), ord(b) + 1) for a, b in ("AZ", "az", "09"))
_MARKS, _ENDS = [ord(c) for c in "#$%&*@^~_=+<>{}[]\\/"], [ord(c) for c in ".,;:?"]


def stats(data: bytes) -> list[float]:
    """The transformed statistics of a text in UTF-8."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    words = data.split()
    nw, lines = len(words), [x for x in data.split(b"\n") if x.strip()]
    distinct = len(set(words))
    upper, lower, digits = (int(counts[s].sum()) for s in (_UPPER, _LOWER, _DIGIT))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    share = lambda x, of: math.sqrt(x / of) if of else 0.0
    found = [
        math.log1p(n),
        math.log1p(n / nw) if nw else 0.0,
        share(upper, upper + lower),
        share(digits, n),
        math.log1p(10 * int(counts[ord("|")]) / nw) if nw else 0.0,
        math.log1p(10 * int(counts[ord("!")]) / nw) if nw else 0.0,
        math.log1p(10 * int(counts[_MARKS].sum()) / nw) if nw else 0.0,
        math.log1p(10 * int(counts[_ENDS].sum()) / nw) if nw else 0.0,
        share(repeats, nw),
        math.log(distinct + 1) / math.log(nw + 2),
        share(distinct, nw),
        math.log1p(len(lines)),
        math.log1p(nw / len(lines)) if lines else 0.0,
        share(len(lines) - len(set(lines)), len(lines)),
        share(sum(w[:1].isupper() for w in words), nw),
        share(n - int(counts[:128].sum()), n),
    ]
    return [round(x * UNIT) / UNIT for x in found]


def statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``: each document's vector."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                x = pa.array([stats(b) for b in as_bytes(part.column(1))], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), x], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of the classes 0 and 1, and the log prior ratio."""

    prior: float
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    logdets: tuple[float, float] = (0.0, 0.0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        if self.means is not None:
            for sign, mean, factor, logdet in zip((-1, 1), self.means, self.factors, self.logdets, strict=True):
                y = (x - mean) @ factor.T
                z -= sign * 0.5 * ((y * y).sum(axis=1) + logdet)
        return 1 / (1 + np.exp(-np.clip(z, -MOST_LOGIT, MOST_LOGIT)))


def fit(x: DataFrame, labels: DataFrame, column: str = "quality") -> Discriminant:
    """The discriminant of the vectors ``(doc_id, x)`` for labels ``(doc_id, <column>)`` of 0 and 1."""
    rows = labels.where(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.min(column).alias("y")).join(x, "doc_id")
    at = [(i, j) for i in range(N_STATS) for j in range(i, N_STATS)]
    # Statistics are multiples of 1 / UNIT, so sums of whole numbers are the same in any order; products are added in two parts.
    rows = rows.select("y", F.transform("x", lambda v: (v * UNIT).cast("long")).alias("x"))
    products = [F.col("x")[i] * F.col("x")[j] for i, j in at]
    sums = [F.sum(F.col("x")[i]) for i in range(N_STATS)] + [F.sum(F.shiftright(p, PART)) for p in products] + [F.sum(p.bitwiseAND(F.lit((1 << PART) - 1))) for p in products]
    by = {}
    for y, many, *totals in rows.groupBy("y").agg(F.count("*"), *sums).collect():  # two rows
        high, low = totals[N_STATS : N_STATS + len(at)], totals[N_STATS + len(at) :]
        by[y] = (y, many, *(v / UNIT for v in totals[:N_STATS]), *(((h << PART) + v) / UNIT**2 for h, v in zip(high, low, strict=True)))
    n = [by[c][1] if c in by else 0 for c in (0, 1)]
    if min(n) < 2:
        return Discriminant(math.log((n[1] or 1) / (n[0] or 1)) if sum(n) else 0.0)
    means, scatters = [], []
    for c in (0, 1):
        mean = np.array(by[c][2 : 2 + N_STATS]) / n[c]
        second = np.zeros((N_STATS, N_STATS))
        for (i, j), v in zip(at, by[c][2 + N_STATS :], strict=True):
            second[i, j] = second[j, i] = v / n[c]
        means.append(mean)
        scatters.append(second - np.outer(mean, mean))
    pooled = (n[0] * scatters[0] + n[1] * scatters[1]) / sum(n)
    factors, logdets = [], []
    for s in scatters:
        s = (1 - TO_POOLED) * s + TO_POOLED * pooled
        s = (1 - TO_DIAGONAL) * s + TO_DIAGONAL * np.diag(np.diag(s)) + RIDGE * np.eye(N_STATS)
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        logdets.append(2 * float(np.log(np.diag(lower)).sum()))
    return Discriminant(math.log(n[1] / n[0]), tuple(means), tuple(factors), tuple(logdets))


def score(x: DataFrame, model: Discriminant) -> DataFrame:
    """``(doc_id, score)`` for each vector."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(vectors))], ["doc_id", "score"])

    kind = x.schema["doc_id"].dataType.simpleString()
    return x.mapInArrow(run, f"doc_id {kind}, score double")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; learns from the labels of rows that aren't held out."""
    x = keep(statistics(docs), "statistics")
    model = fit(x, labels.where(~held_out()))
    scored = score(x, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with all their columns; only labelled ones are read to fit."""
    training = labels.where(~held_out())
    ids = keep(training.select("doc_id").distinct(), "labelled")
    x = keep(statistics(docs.join(small_enough(ids), "doc_id", "left_semi")), "statistics")
    model = fit(x, training)
    forget(ids, x)
    cols, at = docs.columns, docs.columns.index("text")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                vectors = np.array([stats(b) for b in as_bytes(part.column(at))])
                yield part.filter(pa.array(model.scores(vectors) >= THRESHOLD))

    return docs.select(cols).mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
