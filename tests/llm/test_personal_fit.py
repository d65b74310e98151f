"""The trees of personal data learn from every candidate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import personal


def table_of(spark, x, y, held):
    rows = [(int(h), int(k), [float(v) for v in r]) for h, k, r in zip(held, y, x, strict=True)]
    return spark.createDataFrame(rows, "held int, label int, features array<double>")


def plain_thresholds(score, kind, y):
    out = np.full(4, np.inf)
    for k in range(4):
        s, right = score[kind == k], y[kind == k]
        good = [t for t in np.unique(s) if (s >= t).sum() >= 20 and right[s >= t].sum() >= 0.9 * (s >= t).sum()]
        if good:
            below = max(s[s < good[0]], default=0.0)
            out[k] = min(good[0], max(0.5, (good[0] + below) / 2))
    return out


def test_every_candidate_counts_in_trees_and_thresholds(spark, monkeypatch):
    """30,000 candidates, of which a sample of 20,000 cannot hold all; parts do not matter."""
    monkeypatch.setattr(personal, "ROUNDS", 6)
    rng = np.random.default_rng(3)
    n = 30_000
    kind = rng.integers(0, 4, n)
    x = np.concatenate([np.eye(4)[kind], rng.integers(0, 40, (n, 3))], axis=1)
    y = (x[:, 4] + 5 * (kind == 1) + rng.integers(0, 12, n) > 30).astype(int)
    held = rng.integers(0, 2, n)
    seen = spark.sparkContext.accumulator(0)
    slopes = personal.slopes

    def counting(*args):
        inner = slopes(*args)

        def run(batches):
            def each():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            yield from inner(each())

        return run

    monkeypatch.setattr(personal, "slopes", counting)
    rows = table_of(spark, x, y, held)
    model = personal.fit(rows)
    assert seen.value == int((held == 0).sum()) * personal.ROUNDS * personal.DEPTH
    score = model.scores(x)
    assert np.array_equal(model.thresholds, plain_thresholds(score[held == 1], kind[held == 1], y[held == 1]))
    right = ((score > 0.5) == y).mean()
    assert right > 0.85
    monkeypatch.setattr(personal, "TASK_ROWS", 1000)
    again = personal.fit(rows.repartition(5, F.rand(1)))
    assert again.thresholds.tolist() == model.thresholds.tolist() and np.array_equal(again.scores(x), score)
