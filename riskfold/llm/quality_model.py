"""Quality classifier: regularised quadratic discriminant.

``STATISTICS`` of a whole text are transformed so that they spread evenly
(logs of counts and lengths, square roots of shares).  Each class has a mean
and a covariance; the covariance is shrunk towards the pooled one by
``POOLED`` and towards a multiple of the identity by ``ROUND``, so that it can
always be factored.  The Cholesky factors are made once and cached in the
model: a score needs one triangular product a class for the Mahalanobis
distance, and the difference of the log densities plus the log odds of the
classes, divided by ``TEMPERATURE`` (the statistics are not independent
evidence), goes through the logistic function.

Moments are exact sums over all learning rows: statistics are fixed-point
numbers (``UNIT`` steps), so that the sums do not depend on the order or
number of tasks.  The driver receives one row a class.

Null text counts as empty; an empty text has all statistics zero and is scored
like any other.  Labels other than 0 and 1, null ids and ids without a
document teach nothing; with one class only every score is that class's share,
0.0 without labels.  Repeated rows are scored alike and repeated labels count
again.  An empty table gives an empty result.  Output columns replace input
columns of the same name.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField

from riskfold.llm.common import add_columns, documents, held_out, stash

THRESHOLD, POOLED, ROUND, TEMPERATURE, UNIT = 0.7, 0.1, 0.02, 4.0, 4096
#: Pieces of a text (bytes) and windows (words) that are counted at a time, so that a very long text stays bounded.
_PIECE = 1 << 20

STATISTICS = ("words", "mean_word_length", "long_words", "distinct_words", "top_word", "repeated_pairs", "capitals", "digits",
              "symbols", "marks", "other_bytes", "lines", "repeated_lines", "sentence_ends", "marked_words")

_LOWER = np.frombuffer(bytes(range(97, 123)), np.uint8)
_UPPER = np.frombuffer(bytes(range(65, 91)), np.uint8)
_DIGIT = np.frombuffer(b"0123456789", np.uint8)
_SYMBOL = np.frombuffer(b"#*$%&|<>{}[]\\^~_=+@/`", np.uint8)
_MARK = np.frombuffer(b"!?.,;:\"'()-", np.uint8)
_ENDS = (b".", b"!", b"?")
_INNER = b"#*$%&|<>!~^="


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    seen = np.zeros(256, np.int64)
    for lo in range(0, len(raw), _PIECE):
        seen += np.bincount(np.frombuffer(raw, np.uint8, min(_PIECE, len(raw) - lo), lo), minlength=256)
    ink = sum(map(len, words))
    lower, upper = int(seen[_LOWER].sum()), int(seen[_UPPER].sum())
    folded = raw.lower().split()
    counts = Counter(folded)
    pairs = len(set(zip(folded, folded[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda part, whole: math.sqrt(part / max(whole, 1))
    return [
        math.log1p(n),
        math.log(ink / n),
        share(sum([len(w) > 20 for w in words]), n),
        math.log(len(counts)) / math.log(n) if n > 1 else 1.0,
        share(max(counts.values()) - 1, n),
        share(n - 1 - pairs, n),
        share(upper, upper + lower),
        share(int(seen[_DIGIT].sum()), ink),
        share(int(seen[_SYMBOL].sum()), ink),
        share(int(seen[_MARK].sum()), ink),
        share(int(seen[128:].sum()), ink),
        math.log(n / len(lines)),
        share(len(lines) - len(set(lines)), len(lines)),
        share(sum([w.endswith(_ENDS) for w in words]), n),
        share(sum([w[-1] in _INNER for w in words]), n),
    ]


def with_statistics(docs: DataFrame, text: str = "text", into: str = "statistics") -> DataFrame:
    """``docs`` plus the array ``into`` of fixed-point statistics."""

    def make():
        return lambda texts: [[[round(v * UNIT) for v in statistics(t)] for t in texts]]

    return add_columns(docs, [text], [StructField(into, ArrayType(LongType()))], make, rows=256)


@dataclass
class Model:
    """Per class: log share, mean, Cholesky factor and half its log
    determinant; ``share`` alone decides where a class is missing."""

    share: float
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    half_logs: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of fixed-point statistics."""
        if not self.means:
            return np.full(len(x), self.share)
        z = (x / UNIT - self.centre) / self.scale
        density = []
        for mean, inverse, half in zip(self.means, self.inverses, self.half_logs):
            d = (z - mean) @ inverse.T  # the factor's inverse: its square is the Mahalanobis distance
            density.append(-0.5 * (d * d).sum(1) - half)
        odds = (density[1] - density[0]) / TEMPERATURE + math.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def moments(learn: DataFrame, label: str = "quality", column: str = "statistics") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """{class: (rows, sums, sums of products)} of the learning rows, exact."""
    p = len(STATISTICS)
    at = [F.col(column)[i].cast("decimal(19,0)") for i in range(p)]
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(at)]
    squares = [F.sum((F.col(column)[i] * F.col(column)[j]).cast("decimal(19,0)")).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]
    out = {}
    for r in learn.groupBy(label).agg(F.count("*").alias("n"), *sums, *squares).collect():
        q = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                q[i, j] = q[j, i] = float(r[f"q{i}_{j}"]) / UNIT / UNIT
        out[int(r[label])] = (int(r["n"]), np.array([float(r[f"s{i}"]) for i in range(p)]) / UNIT, q)
    return out


def fit(found: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float = POOLED, round_: float = ROUND) -> Model:
    p = len(STATISTICS)
    total = sum(n for n, _, _ in found.values())
    ones = found.get(1, (0, None, None))[0]
    if len(found) < 2:
        return Model(ones / total if total else 0.0, np.zeros(p), np.ones(p), [], [], [])
    centre = sum(s for _, s, _ in found.values()) / total
    spread = sum(q for _, _, q in found.values()) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-6))
    covariances, means = [], []
    for k in (0, 1):
        n, s, q = found[k]
        mean = s / n
        means.append((mean - centre) / scale)
        covariances.append((q / n - np.outer(mean, mean)) / np.outer(scale, scale))
    within = (found[0][0] * covariances[0] + found[1][0] * covariances[1]) / total
    inverses, halves = [], []
    for own in covariances:
        mixed = (1 - pooled) * own + pooled * within
        mixed = (1 - round_) * mixed + round_ * (np.trace(mixed) / p + 1e-6) * np.eye(p)
        factor = np.linalg.cholesky((mixed + mixed.T) / 2)
        inverses.append(np.linalg.inv(factor))
        halves.append(float(np.log(np.diag(factor)).sum()))
    return Model(ones / total, centre, scale, means, inverses, halves)


def train(learn: DataFrame, label: str = "quality", column: str = "statistics") -> Model:
    """Model from learning rows (statistics, label)."""
    return fit(moments(learn.where(F.col(label).isin(0, 1)), label, column))


def score(rows: DataFrame, model: Model, column: str = "statistics") -> DataFrame:
    """``rows`` plus ``score`` and ``predicted``, from the statistics."""

    def make():
        def work(x: list) -> list:
            made = model.scores(np.array(x, np.float64).reshape(-1, len(STATISTICS)))
            return [made.tolist(), (made >= THRESHOLD).astype(int).tolist()]
        return work

    return add_columns(rows, [column], [StructField("score", DoubleType()), StructField("predicted", IntegerType())], make, rows=4096)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """``docs`` plus ``score`` and ``predicted``; learns from ``labels``
    (doc_id, label).  The statistics are made once and written."""
    made = {"score", "predicted"}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made and c != text])
    keyed = docs.select(row.alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = stash(with_statistics(keyed).drop("text"), "quality-statistics")
    named = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    model = train(rows.select("id", "statistics").join(named, "id"), "label")
    return score(rows, model).select("row.*", "score", "predicted")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 4, 2))
    out = classify(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return out.select("doc_id", held_out("doc_id", 4, 2).cast(BooleanType()).alias("held_out"), "score", "predicted")
