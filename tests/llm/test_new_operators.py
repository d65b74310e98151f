"""Collocations, personal data and the prefix trie against plain versions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.brute_trie import brute_trie
from tickloom.llm import collocations, personal, prefixtrie
from tickloom.llm.text import slices

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain_spans(text):
    out = []
    for order, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="0145+.-() @aé,", max_size=60), max_size=4))
def test_base_spans_are_those_of_the_patterns(texts):
    body = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, body)]).astype(np.int64)
    data = np.frombuffer(b"".join(body), dtype=np.uint8)
    part = personal.Texts(0, len(texts), data, offsets)
    for text, found in zip(texts, personal.chosen(part, None), strict=True):
        at = offsets[texts.index(text)]
        raw = text.encode()
        got = []
        for a, k, b, *_ in found:
            low = next(o for o in offsets[:-1][::-1] if o <= a)
            got.append(f"{personal.KINDS[k]}:{len(raw[: a - low].decode())}:{len(raw[: b - low].decode())}")
        assert at >= 0 and got == plain_spans(text)


def test_personal_data_of_awkward_rows(spark, docs, awkward):
    extra = [(20, "mail é.a.b@c.de or +1 (555) 123-4567, 4111 1111 1111 1111 from 10.0.0.1.2.3.4.5"), (21, "1" * 50_000), (22, "a" * 50_000 + "@")]
    rows = awkward + extra
    found = personal.personal_data(docs(rows), redact=True)
    got = sorted(
        ((r["doc_id"] is None, r["doc_id"] or 0), r["base_sha256"], r["n_ip"])
        for r in found.select("doc_id", *personal.digests(found)).collect()
    )
    want = sorted(
        ((i is None, i or 0), hashlib.sha256(",".join(plain_spans(t)).encode()).hexdigest(), sum(s.startswith("ip") for s in plain_spans(t)))
        for i, t in rows
    )
    assert got == want
    text = found.where("doc_id = 20").first()["redacted"]
    assert "<email> or <phone>, <card> from <ip>" in text and "4111" not in text
    assert personal.personal_data(docs([])).count() == 0


def test_loose_forms_are_added_where_the_trees_are_sure(spark, docs):
    """Numbers without a country code beside cue words are found; other numbers are left."""
    rows = [(i, f"please call +1 (555) {100 + i}-{4000 + i} soon or write to a{i}@mail.example.com today") for i in range(300)]
    rows += [(1000 + i, f"order number {7_000_000 + 37 * i} shipped, batch {i}") for i in range(300)]
    rows += [(2000, "please call (555) 777-1234 soon"), (2001, "write to b217 (at) mail.example.com today"), (2002, "order number 7654321 shipped")]
    found = {r["doc_id"]: [s["kind"] for s in r["found"] if not s["base"]] for r in personal.personal_data(docs(rows)).collect()}
    assert found[2000] == ["phone"] and found[2001] == ["email"] and found[2002] == []


def plain_collocations(rows, threshold, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = [x for x in re.split(r"[\x20\t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= threshold}
    out = []
    for (lang, *w), a in found.items():
        covered = any(
            len(q) > len(w) + 1 and q[0] == lang and 100 * b >= 50 * a
            and any(list(q[i : i + len(w)]) == w for i in range(1, len(q) - len(w) + 1))
            for q, b in found.items()
        )
        if not covered:
            cuts = [(10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    result, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return result


@pytest.mark.parametrize("shards", [1, 3])
def test_collocations_are_those_of_plain_counts(spark, shards):
    rng = np.random.default_rng(5)
    rows = [
        (["en", "de", None][i % 3], " ".join(rng.choice(["New", "york", "a", "b", "ß", "b.", "a,"], 40)))
        for i in range(120)
    ]
    rows += [(None, None), ("en", ""), ("x\ny", "p q " * 30), ("en", "one\ttwo  three. " * 12)] * 2
    df = spark.createDataFrame([(lang, text, "c", 1) for lang, text in rows], "lang string, text string, phrase string, n long")
    got = collocations.collocations(df, threshold=10, top=30, shards=shards)
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(plain_collocations(rows, 10, 30))


def test_phrases_whose_slots_are_taken_early_are_counted_for_a_whole_cycle():
    """Words become active at step 2; other phrases have taken the slots of their pairs at step 1."""
    (texts,) = slices(pa.array(["p q r"]))
    shown = collocations.Slice(texts.data, texts, np.zeros(1, np.int64), pa.array(["en"], pa.large_string()))
    steps = tuple(np.full(1 << 8, at, np.uint8) for at in (2, 1))
    seen = {2: [], 3: []}
    for step in range(8):
        for size, began, _, _ in collocations.counted(shown, step, 4, steps):
            seen.get(size, []).append((step, *began))
    assert [s for s, *_ in seen[3]] == [2, 3, 4, 5] and {b for _, b in seen[3]} == {2}
    assert sorted({s for s, *_ in seen[2]}) == [2, 3, 4, 5]


def test_collocations_of_an_empty_table(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df, shards=2).count() == 0


@pytest.mark.parametrize("part_rows", [3, 1000])
def test_prefix_trie_is_that_of_plain_prefixes(spark, part_rows):
    rng = np.random.default_rng(3)
    rows = []
    for conv in [*range(0, 60), 100, 101, 199, 100_007]:
        for turn in range(int(rng.integers(1, 7))):
            text = None if rng.random() < 0.1 else "é" * int(rng.integers(0, 3))
            rows.append((conv, None if rng.random() < 0.1 else turn, ["user", None][turn % 2], text))
    rows += [(3, 1, "user", "x"), (3, 1, "user", "x"), (None, 1, "user", "lost"), (7, 2, "b", "2"), (7, 2, "b", "1")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn int, role string, text string, marks string, part string")
    got = prefixtrie.prefix_trie(df, part_rows)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == brute_trie(rows)


def test_prefix_trie_of_an_empty_table(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
