"""The pipeline, stage by stage, against a plain version of every stage."""

from __future__ import annotations

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from test_operators import WHITE, brute_cut, low, reachable, sets_of
from tickloom.llm import classify, packing, text

pytest.importorskip("public_tokenizers")


def corpus(seed):
    """Prose, shouting, near copies, shared passages, leaked benchmark items, null and empty rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(500)]

    def prose(n):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", "", ",", "."]) for _ in range(n)]
        return words

    passage, items = prose(60), [" ".join(prose(25)) for _ in range(4)]
    rows, labels = [], []
    for i in range(140):
        words, good = prose(rng.randint(25, 140)), 1
        if i % 7 == 3:
            words, good = [w.upper() + "!!" for w in words], 0
        elif i % 7 == 5 and rows:
            words = list(rng.choice(rows)[1].split())
            words[rng.randrange(len(words))] = "edit"
            good = 0 if "!!" in words[0] + words[-1] else 1
        if i % 11 == 4 and good:
            words[5:5] = passage
        if i % 17 == 6 and good:
            words += items[i % 4].split()
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, good))
    rows += [(200, None), (201, ""), (None, " ".join(prose(40))), (7, rows[7][1])]
    return rows, labels, list(enumerate(items))


def plain_quality(rows, labels):
    x = np.concatenate([classify.statistics(t) for t in text.slices(pa.array([r[1] for r in rows], pa.string()))])
    by_id = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        by_id[i].append(k)
    taught = [(k, q) for i, q in labels for k in by_id[i]]
    every = x[[k for k, _ in taught]]
    spread = np.sqrt(np.maximum(every.var(axis=0), 1e-6))
    density = []
    for c in (0, 1):
        own = x[[k for k, q in taught if q == c]]
        unit = np.cov((own / spread).T, bias=True)
        unit = 0.9 * unit + 0.1 * max(np.trace(unit) / len(unit), 0.05) * np.eye(len(unit))
        z = (x - own.mean(axis=0)) / spread
        m = np.einsum("ij,jk,ik->i", z, np.linalg.inv(unit), z)
        density.append(np.log(len(own) / len(taught)) - 0.5 * (m + np.linalg.slogdet(unit)[1]))
    return [r for r, d in zip(rows, density[1] - density[0], strict=True) if d >= 0]


def plain_near(rows):
    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    root = reachable({i for i, _ in sets}, links)
    return [r for r in dict.fromkeys(rows) if r[0] is None or root[r[0]] == r[0]]


def plain_substring(rows):
    cut = brute_cut(rows, 35, lambda t: re.findall(WHITE, t or ""))
    return [(i, " ".join(k) if m else t) for (i, t), (_, _, m, _, k) in zip(rows, cut, strict=True)]


def plain_clean(rows, items):
    def bag(words):
        return collections.Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))

    def leaked(t):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        for _, item in items:
            want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(item))
            size = min(len(words), len(want))
            for p in range(len(words) - size + 1 if words else 0):
                a, b = bag(words[p : p + size]), bag(want)
                both = sum((a & b).values())
                if both >= 0.75 * (sum(a.values()) + sum(b.values()) - both) - 1e-12:
                    return True
        return False

    return [r for r in rows if not leaked(r[1])]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_every_stage_matches_its_plain_version(spark, tmp_path):
    rows, labels, items = corpus(21)
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = [
        lambda r: plain_quality(r, labels),
        plain_near,
        plain_substring,
        lambda r: plain_clean(r, items),
    ]
    docs, want = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES[:4], plain, strict=True):
        before = len(want)
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs, want = spark.read.parquet(str(tmp_path / name)), by_hand(want)
        got = docs.collect()
        assert order((r.doc_id, r.text) for r in got) == order(want), name
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
        assert name == "substring_dedup" or len(want) < before
    import public_tokenizers

    encoder = packing.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    tokens = sorted(len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in want)
    name, stage = corpus_pipeline.STAGES[4]
    pieces = stage(spark, docs, str(tmp_path)).collect()
    ends = [p.doc_tokens for p in pieces if p.start + p.length == p.doc_tokens]
    assert sorted(ends) == tokens and sum(p.length for p in pieces) == sum(tokens)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() >= len(want) and whole.agg({"length": "sum"}).first()[0] == sum(tokens)


def test_stages_take_columns_of_their_own_names(spark):
    """Extra columns named like the stages' inner ones come through every filtering stage unchanged."""
    from tickloom.llm.stages import STAGES

    extra = "_name string, kept string, n_removed string, _whole string, n_words string, carry string"
    prose = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(4)]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t), *"abcdef") for i, t in enumerate(prose)],
        f"doc_id long, text string, lang string, source string, n_chars long, {extra}",
    )
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        for row in out.collect():
            assert tuple(row)[5:] == tuple("abcdef")
        if name == "substring_dedup":
            assert {r["text"] for r in out.collect()} == set(prose)
