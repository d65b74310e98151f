"""Quality classifier: quadratic discriminant on transformed statistics of the text.

Each class is a Gaussian with its own covariance, shrunk towards a multiple of the identity so it
always has a Cholesky factor. The log-density difference of the classes, from Mahalanobis
distances under the cached factors, gives the score. Spark sums the moments; only two d x d
matrices reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import NEWLINE, WHITE, keyed, slices, split, table, word_codes
from tickloom.session import materialised

UPPER = table((65, 90))
LETTER = table((65, 90), (97, 122), (128, 255))
DIGIT = table((48, 57))
STOPS = table((0x2C, 0x2C), (0x2E, 0x2E))
SYMBOL = table((0x21, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
BARS = table((0x7C, 0x7C))
CRIES = table((0x21, 0x21))

STATISTICS = (
    "word_length upper digits stops symbols bars cries symbol_ends repeated_lines repeated_words"
).split()
FLOOR = 0.01


def statistics(texts) -> np.ndarray:
    """One row of transformed statistics per text; an empty text has every share at zero."""
    n = len(texts.offsets) - 1
    words, lines = split(texts, WHITE), split(texts, NEWLINE)

    def count(kind: np.ndarray) -> np.ndarray:
        running = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum(kind[texts.data], out=running[1:])
        return np.diff(running[texts.offsets]).astype(float)

    def distinct(spans) -> np.ndarray:
        codes = word_codes(texts.data, spans)
        text = np.repeat(np.arange(n), spans.counts)
        order = np.lexsort((codes, text))
        codes, text = codes[order], text[order]
        new = np.ones(len(codes), dtype=bool)
        new[1:] = (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])
        return np.bincount(text[new], minlength=n).astype(float)

    size = np.diff(texts.offsets).astype(float)
    n_words, n_lines = words.counts.astype(float), lines.counts.astype(float)
    letters = count(LETTER)
    running = np.zeros(len(words.end) + 1, np.int64)
    if len(words.end):
        np.cumsum(SYMBOL[texts.data[words.end - 1]], out=running[1:])
    symbol_ends = np.diff(running[words.first]).astype(float)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.log(FLOOR + part / np.maximum(whole, 1.0))

    columns = [
        np.log1p(letters / np.maximum(n_words, 1.0)),
        share(count(UPPER), letters),
        share(count(DIGIT), size),
        share(count(STOPS), size),
        share(count(SYMBOL), size),
        share(count(BARS), size),
        share(count(CRIES), size),
        share(symbol_ends, n_words),
        share(n_lines - distinct(lines), n_lines),
        share((n_words - distinct(words)) / np.log2(n_words + 4.0), n_words),
    ]
    return np.stack(columns, axis=1)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and its statistics ``x``; one row per input row."""
    schema = keyed(docs, id_col, "x array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                x = statistics(texts)
                values = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel())
                )
                ids = batch.column(0).slice(texts.low, texts.high - texts.low)
                yield pa.RecordBatch.from_arrays([ids, values], ["_id", "x"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log weights of classes 0 and 1."""

    means: np.ndarray
    whiten: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1, divided by the number of statistics so that scores do not saturate."""
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.whiten[k].T
            density.append(self.weights[k] - 0.5 * np.einsum("ij,ij->i", z, z))
        return (density[1] - density[0]) / x.shape[1]


def fit(labelled: DataFrame, shrinkage: float = 0.1) -> Discriminant | None:
    """Fit on rows of ``x`` and ``label`` (0 or 1; other rows are ignored); None without both classes."""
    d = len(STATISTICS)
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    sums += [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = labelled.where("label IN (0, 1)").groupBy("label").agg(F.count("*").alias("n"), *sums).collect()
    moments = {r["label"]: r for r in rows}
    if set(moments) != {0, 1}:
        return None
    means, whiten, weights = [], [], []
    total = sum(r["n"] for r in rows)
    scale = sum(np.array([r[f"q{i}_{i}"] for i in range(d)]) for r in rows) / total
    centre = sum(np.array([r[f"s{i}"] for i in range(d)]) for r in rows) / total
    spread = np.maximum(scale - centre**2, 1e-6)
    for k in (0, 1):
        r = moments[k]
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        square = np.empty((d, d))
        for i in range(d):
            for j in range(i, d):
                square[i, j] = square[j, i] = r[f"q{i}_{j}"] / r["n"]
        covariance = square - np.outer(mean, mean)
        unit = covariance / np.sqrt(np.outer(spread, spread))
        unit = (1 - shrinkage) * unit + shrinkage * max(np.trace(unit) / d, 0.05) * np.eye(d)
        factor = np.linalg.cholesky(unit)
        means.append(mean)
        whiten.append(np.linalg.inv(factor) / np.sqrt(spread))
        weights.append(np.log(r["n"] / total) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(whiten), np.array(weights))


def score(rows: DataFrame, model: Discriminant | None) -> DataFrame:
    """``_id``, ``score``: the probability of label 1; one half for all without a model."""
    schema = keyed(rows, "_id", "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(STATISTICS))
            logit = np.zeros(len(x)) if model is None else np.clip(model.logit(x), -700, 700)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1.0 / (1.0 + np.exp(-logit)))], ["_id", "score"]
            )

    return rows.select("_id", "x").mapInArrow(run, schema)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def classify(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    shrinkage: float = 0.1,
) -> DataFrame:
    """Score every document: ``id_col``, ``score`` in 0..1, ``predicted`` 1 where score >= 0.5.

    ``learn`` is a condition on ``id_col`` of the label rows that may be learned from (all if None).
    Null text scores as empty text. A null label, a label other than 0 and 1, and a null id on
    either side teach nothing; a label row repeated counts as often as it occurs. Without rows of
    both classes every score is one half. Extra columns are ignored; an empty table gives no rows.
    """
    rows = materialised(measured(docs, id_col, text_col))
    taught = labels.where(learn) if learn is not None else labels
    taught = taught.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"))
    model = fit(rows.join(taught, "_id"), shrinkage)
    scored = score(rows, model)
    return scored.select(
        F.col("_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
