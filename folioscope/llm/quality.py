"""Quality: regularised quadratic discriminant analysis over transformed statistics of whole documents.

Each class has a mean and a covariance that is shrunk towards the pooled covariance and towards a multiple of the
identity. Its Cholesky factor L is computed once and kept as the inverse of L, a triangle of 22 x 22 numbers, so that a
Mahalanobis distance is one product for a whole batch; the ridge bounds its condition. The score is the logistic function
of the difference of both log densities, after a scale and shift that are fitted on the sample because quadratic
discriminants are overconfident.

The model is fitted on a bounded sample of labelled rows: up to ``sample_rows`` of each class, those with the smallest
hash of the id, with texts of at most ``sample_chars`` code points; the true shares of the classes are kept as priors.
Rows of the held-out fold are never used. Scores depend on the text alone.

Defined results: a null text counts as empty; an empty text has the statistics of a text of no words, and is scored like
any other; rows whose label is null teach nothing; without two rows of either class every score is the share of label 1
(1 without labels); repeated rows are scored each on its own, and one row of an id teaches; very long texts are measured
whole, in memory linear in the text. score() and accepted() pass other columns on; where ``keep`` has a column ``name``
already, score() puts underscores behind the new one's name until it is free.

Scale: scoring is one pass without a shuffle; the model is a few kilobytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import blobs, crc_fold, free, keyed, labelled_sample, ship, table

FOLDS, HELD = 4, 2
SAMPLE_ROWS, SAMPLE_CHARS = 3_000, 200_000
CUT = 0.7
SHRINK, RIDGE = 0.1, 0.02

_KINDS = np.zeros((256, 10), np.float64)
for _b in range(256):
    _c = chr(_b)
    _k = 0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 3 if _b >= 128 else 4 if _c == " " else 5 if _c == "\n" else 6 if _c in ".," else 7 if _c in "!?" else 8 if _c in "|/\\<>{}[]=_" else 9
    _KINDS[_b, _k] = 1

#: ASCII bytes that seldom end a word of prose.
_ODD_ENDS = frozenset(b for b in range(128) if not chr(b).isalnum() and chr(b) not in ".,;:")

#: Names of the statistics, in order.
STATISTICS = (
    *("lower", "upper", "digit", "beyond_ascii", "blank", "line_end", "stop", "exclamation", "markup", "symbol"),
    *("log_words", "word_length", "word_spread", "distinct_words", "top_word", "top_three", "distinct_lines", "words_a_line", "odd_words", "capital_words", "pair_repeats", "entropy"),
)


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of a whole text: square roots of shares, logarithms of counts."""
    data = text or b""
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = np.sqrt(counts @ _KINDS / n)
    words = data.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    top = [c for _, c in seen.most_common(3)] + [0, 0, 0]
    lines = [x for x in data.split(b"\n") if x]
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters = counts[counts > 0] / n
    odd = sum([c for w, c in seen.items() if w[-1] in _ODD_ENDS])
    capital = sum([c for w, c in seen.items() if 65 <= w[0] <= 90])
    return [
        *shares,
        np.log1p(len(words)),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        np.log((len(seen) + 1) / (m + 1)) / np.log(m + 2),
        np.sqrt(top[0] / m),
        np.sqrt(sum(top[:3]) / m),
        np.log((len(set(lines)) + 1) / (len(lines) + 1)),
        np.log1p(len(words) / max(1, len(lines))),
        np.sqrt(odd / m),
        np.sqrt(capital / m),
        np.sqrt(1 - min(1, (pairs + 1) / m)),
        float(-(letters * np.log(letters)).sum()) if data else 0.0,
    ]


@dataclass
class Model:
    """Means, Cholesky factors and log determinants of both classes; ``rate`` alone where nothing could be fitted."""

    rate: float = 1.0
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    scaled: float = 1.0
    shifted: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0."""
        z = (x - self.centre) / self.scale
        logs = []
        for mean, inverse in zip(self.means, self.factors, strict=True):
            logs.append(-0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) + np.log(np.diag(inverse)).sum())
        return logs[1] - logs[0]

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.means is None:
            return np.full(len(texts), self.rate)
        d = self.difference(np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS)))
        return 1 / (1 + np.exp(-np.clip(self.scaled * d + self.shifted, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray, shrink: float = SHRINK, ridge: float = RIDGE) -> Model:
    """Fit on statistics x, labels y and weights w."""
    share = float(np.average(y, weights=w)) if len(y) else 1.0
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Model(rate=share)
    model = Model(share, x.mean(0), x.std(0) + 1e-6)
    z = (x - model.centre) / model.scale
    covariances = [np.cov(z[y == c].T) for c in (0, 1)]
    pooled = (covariances[0] + covariances[1]) / 2
    model.means = np.array([z[y == c].mean(0) for c in (0, 1)])
    factors = []
    for c in covariances:
        c = (1 - shrink) * c + shrink * pooled
        c = (1 - ridge) * c + ridge * np.trace(c) / len(c) * np.eye(len(c))
        factors.append(np.linalg.inv(np.linalg.cholesky(c)))
    model.factors = np.array(factors)
    d = model.difference(x)
    unit = float(np.abs(d).mean()) + 1e-9
    d, a, b, w = d / unit, 1.0, 0.0, w / w.sum()
    for _ in range(50):  # Newton steps of a weighted logistic regression on the difference
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        h = w * p * (1 - p) + 1e-12
        g = np.array([(w * (p - y) * d).sum() + 1e-4 * a, (w * (p - y)).sum()])
        step = np.linalg.solve(np.array([[(h * d * d).sum() + 1e-4, (h * d).sum()], [(h * d).sum(), h.sum() + 1e-9]]), g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    model.scaled, model.shifted = float(a / unit), float(b)
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = FOLDS, held: int = HELD, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model fitted on the labelled rows of docs that are not held out."""
    found, shares = labelled_sample(keyed(docs, doc_id=doc_id, text=text), keyed(labels, doc_id=doc_id, label=label), crc_fold("doc_id", folds) == held, sample_rows, sample_chars)
    rows = found.select("label", "text").mapInArrow(_measured, "label int, x array<double>").collect()
    rows = sorted((r.label, r.x) for r in rows)
    y = np.array([r[0] for r in rows], np.float64)
    w = np.array([shares[r[0]] / (y == r[0]).sum() for r in rows])
    return train(np.array([r[1] for r in rows]).reshape(len(rows), len(STATISTICS)), y, w)


def _measured(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in blobs(batch.column(1))], pa.list_(pa.float64()))], names=["label", "x"])


def _scored(shared, at: int, keep: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            scores = shared.value.score(blobs(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(scores, pa.float64())], names=[*batch.schema.names[:keep], "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` of docs (all by default) and the score of each text."""
    spark = ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    name = free(name, keep)
    names = list(dict.fromkeys([*keep, text]))
    read = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*[f"c{i}" for i in range(len(names))])
    kinds = [f"c{i} {read.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return read.mapInArrow(_scored(spark.sparkContext.broadcast(model), names.index(text), len(keep)), ", ".join([*kinds, "score double"])).toDF(*keep, name)


def accepted(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of docs that score at least ``cut``, with their columns."""
    name = free("score", docs.columns)
    return score(docs, model, text, name=name).where(F.col(name) >= cut).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; predicted is 1 from 0.7."""
    docs = table(spark, sf_dir, "documents")
    ship(spark)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (crc_fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


SQL = None
