"""Personal data: spans by fixed formats, and more by boosted trees over high-recall candidates.

The base spans of a kind are found from its rare bytes (``@``, ``+``, runs of digits), so long texts
cost one look at each byte. Generators then propose overlapping candidates of looser formats: numbers with
other separators or without a country code, addresses with written-out signs. Gradient boosted trees
score candidates by format and context. Their labels come from the corpus itself: base spans and rewritten
base spans are positive, candidates without a base span are negative. Each kind's threshold is
the lowest at which nine in ten chosen candidates of the held-out half are positive, moved half way to
the next lower score but not below one half; a kind that never gets there adds nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.text import Texts, keyed, slices, split, table
from tickloom.session import materialised

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Bounds of the fit.
ROUNDS, DEPTH, RATE, BINS = 50, 3, 0.2, 32
PRECISION, LEAST_CHOSEN = 0.9, 20
#: Slices of the score, and the candidates that are worth a task of their own.
SLICES, TASK_ROWS = 4096, 1 << 18

DIGIT = table((48, 57))
LOCAL = table((48, 57), (65, 90), (97, 122), *((b, b) for b in b"._%+-"))
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIALLED = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
BEFORE_AT = re.compile(rb"[A-Za-z0-9._%+-]{1,64}[ ]?$")
AFTER_AT = re.compile(
    rb"[ ]?[A-Za-z0-9-]{1,63}(?:(?:[ ]?[(\[{][ ]?dot[ ]?[)\]}][ ]?| dot |\.)[A-Za-z0-9-]{1,63})+", re.IGNORECASE
)
LOOSE_LEFT = re.compile(rb"[^\s@<>\"'(),;:\[\]]{1,64}$")
LOOSE_RIGHT = re.compile(rb"[^\s@<>\"'(),;:\[\]]{1,253}")
#: Words that announce a kind.
CUES = (
    re.compile(rb"mail|contact|write", re.IGNORECASE),
    re.compile(rb"\bip\b|host|server|addr", re.IGNORECASE),
    re.compile(rb"card|visa|credit|account", re.IGNORECASE),
    re.compile(rb"tel|phone|call|fax|mobile", re.IGNORECASE),
    re.compile(rb"token|key|version|id\b|no\b|isbn", re.IGNORECASE),
)
CONTEXT = 24

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: bytes) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = (digit - 48) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def small(part: bytes) -> bool:
    """Whether a run of digits is at most 255, however long it is."""
    part = part.lstrip(b"0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def chains(link: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last run of the maximal chains of linked runs."""
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(~link)
    return np.concatenate([[0], edge + 1]), np.concatenate([edge, [n - 1]])


class Runs:
    """Runs of digits of some texts, and which follow each other in one text after ``gap`` bytes."""

    def __init__(self, texts: Texts):
        runs = split(texts, ~DIGIT)
        self.data, self.start, self.end = texts.data, runs.start, runs.end
        self.text = np.repeat(np.arange(len(runs.counts)), runs.counts)
        self.n = len(self.start)
        self.same = self.text[1:] == self.text[:-1]
        self.gap = self.start[1:] - self.end[:-1]
        self.between = self.data[self.end[:-1]] if self.n else self.data[:0]

    def linked(self, signs: bytes) -> tuple[np.ndarray, np.ndarray]:
        return chains(self.same & (self.gap == 1) & np.isin(self.between, list(signs)), self.n)


def base_spans(texts: Texts, runs: Runs, body: bytes) -> list[Span]:
    """Spans of the fixed formats, by start and kind."""
    out: list[Span] = []
    first, last = runs.linked(b".")
    for a, b in zip(*(x[last - first >= 3] for x in (first, last)), strict=True):
        for j in range(a, b - 2, 4):
            if all(small(body[runs.start[k] : runs.end[k]]) for k in range(j, j + 4)):
                out.append((int(runs.start[j]), IP, int(runs.end[j + 3])))
    first, last = runs.linked(b" -")
    long = np.concatenate([[0], np.cumsum(runs.end - runs.start)])
    digits = long[last + 1] - long[first]
    fits = (digits >= 12) & (digits <= 19)
    for a, b in zip(first[fits], last[fits], strict=True):
        start, end = int(runs.start[a]), int(runs.end[b])
        if luhn(body[start:end].translate(None, b" -")):
            out.append((start, CARD, end))
    for at in np.flatnonzero(texts.data == 43):
        limit = int(texts.offsets[np.searchsorted(texts.offsets, at, "right")])
        found = DIALLED.match(body, int(at), limit)
        if found and 9 <= sum(48 <= c <= 57 for c in found.group()) <= 15:
            out.append((int(at), PHONE, found.end()))
    signs = np.flatnonzero(texts.data == 64)
    outside = np.flatnonzero(~LOCAL[texts.data]) if len(signs) else signs
    done = 0
    for at in signs:
        text = int(np.searchsorted(texts.offsets, at, "right"))
        before = np.searchsorted(outside, at) - 1
        start = max(done, int(texts.offsets[text - 1]), int(outside[before]) + 1 if before >= 0 else 0)
        found = DOMAIN.match(body, int(at) + 1, int(texts.offsets[text])) if start < at else None
        if found:
            out.append((start, EMAIL, done := found.end()))
    return sorted(out)


def candidates(texts: Texts, runs: Runs, body: bytes) -> list[Span]:
    """Loose proposals of all kinds; they may overlap."""
    out: set[Span] = set()
    near = runs.gap == 1
    if runs.n > 1:
        sign = np.isin(runs.between, list(b" -./()"))
        after = np.isin(runs.data[np.minimum(runs.end[:-1] + 1, len(runs.data) - 1)], list(b" -.()"))
        near = runs.same & sign & (near | ((runs.gap == 2) & after))
    first, last = chains(near, runs.n)
    long = np.concatenate([[0], np.cumsum(runs.end - runs.start)])
    digits = long[last + 1] - long[first] if runs.n else long[:0]
    for a, b, n in zip(first, last, digits, strict=True):
        start, end = int(runs.start[a]), int(runs.end[b])
        if 7 <= n <= 15:
            lead = int(texts.offsets[runs.text[a]])
            while start > lead and body[start - 1] in b"(+":
                start -= 1
            out.add((start, PHONE, end))
        start = int(runs.start[a])
        if 12 <= n <= 19:
            out.add((start, CARD, end))
        if b - a == 3 and n <= 12:
            out.add((start, IP, end))
    data = texts.data
    written = np.zeros(0, np.int64)
    if len(data) > 3:
        fold = data | 32
        middle = (fold[1:-2] == 97) & (fold[2:-1] == 116)
        written = np.flatnonzero(middle & np.isin(data[:-3], list(b"([{ ")) & np.isin(data[3:], list(b")]} ")))
    for at, left, right, wide in [
        *((int(p), LOOSE_LEFT, LOOSE_RIGHT, 1) for p in np.flatnonzero(data == 64)),
        *((int(p), BEFORE_AT, AFTER_AT, 4) for p in written),
    ]:
        text = int(np.searchsorted(texts.offsets, at, "right"))
        low, high = int(texts.offsets[text - 1]), int(texts.offsets[text])
        after = right.match(body, at + wide, high)
        before = left.search(body[max(low, at - 65) : at]) if after else None
        if before:
            out.add((at - len(before.group()), EMAIL, after.end()))
    return sorted(out)


def features(body: bytes, low: int, high: int, span: Span) -> list[float]:
    """Format of a candidate and what stands around it, inside its text."""
    start, kind, end = span
    own = body[start:end]
    digits = bytes(c for c in own if 48 <= c <= 57)
    groups = re.findall(rb"[0-9]+", own)
    before, after = body[max(low, start - CONTEXT) : start], body[end : min(high, end + CONTEXT)]
    prev, following = before[-1:] or b"\n", after[:1] or b"\n"
    count = lambda chars: float(sum(own.count(bytes([c])) for c in chars))
    return [
        *(float(kind == k) for k in range(4)),
        float(len(own)), float(len(digits)), float(len(groups)),
        float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0),
        float(max(map(len, groups), default=0)),
        count(b"+"), count(b"("), count(b"-"), count(b"."), count(b" "), count(b"/"), count(b"@"),
        float(b"dot" in own.lower()), float(len(own.rpartition(b".")[2])),
        float(12 <= len(digits) <= 19 and luhn(digits)),
        float(len(groups) == 4 and all(map(small, groups))),
        float(prev.isalnum()), float(following.isalnum()), float(prev.isspace()), float(following.isspace()),
        float(prev in b"\"'=:#/"), float(before[-1:] == b"+"),
        *(float(cue.search(before) is not None) for cue in CUES),
        float(any(48 <= c <= 57 for c in before)), float(any(48 <= c <= 57 for c in after)),
    ]


def rewritten(own: bytes, kind: int) -> list[bytes]:
    """Other ways to write a base span."""
    if kind == EMAIL:
        name, _, host = own.partition(b"@")
        return [name + b" (at) " + host, name + b" [at] " + host.replace(b".", b" [dot] "), name + b" at " + host.replace(b".", b" dot ")]
    if kind == PHONE:
        local = own.partition(b" ")[2] or own[2:]
        return [local, re.sub(rb"[() ]+", b"-", local).strip(b"-"), re.sub(rb"[() -]+", b".", local).strip(b".")]
    if kind == CARD:
        plain = own.translate(None, b" -")
        return [b".".join(plain[i : i + 4] for i in range(0, len(plain), 4))]
    return []


def alone(body: bytes) -> tuple[Texts, Runs]:
    texts = Texts(0, 1, np.frombuffer(body, dtype=np.uint8), np.array([0, len(body)], np.int64))
    return texts, Runs(texts)


def name_of(seen: bytes, kind: int) -> tuple[int, int]:
    """64 bits that stand for a candidate and what surrounds it, and the half it falls into."""
    seen += bytes([kind])
    return int.from_bytes(hashlib.blake2b(seen, digest_size=8).digest(), "little", signed=True), zlib.crc32(seen) & 1


def lessons(texts: Texts) -> Iterator[tuple[int, int, int, list[float]]]:
    """(name, held out, label, features) of every candidate and rewritten base span of some texts."""
    body, runs = texts.data.tobytes(), Runs(texts)
    base = base_spans(texts, runs, body)
    covered = np.zeros(len(body) + 1, dtype=np.uint8)
    for start, kind, end in base:
        covered[start:end] |= 1 << kind
    for start, kind, end in candidates(texts, runs, body):
        text = int(np.searchsorted(texts.offsets, start, "right"))
        low, high = int(texts.offsets[text - 1]), int(texts.offsets[text])
        label = int(bool((covered[start:end] & (1 << kind)).any()))
        named = name_of(body[max(low, start - CONTEXT) : min(high, end + CONTEXT)], kind)
        yield *named, label, features(body, low, high, (start, kind, end))
    for start, kind, end in base:
        text = int(np.searchsorted(texts.offsets, start, "right"))
        before = body[max(int(texts.offsets[text - 1]), start - CONTEXT) : start]
        after = body[end : min(int(texts.offsets[text]), end + CONTEXT)]
        for other in rewritten(body[start:end], kind):
            made = before + other + after
            for span in candidates(*alone(made), made):
                if span[1] == kind and span[0] < len(before) + len(other) and span[2] > len(before):
                    yield *name_of(made, kind), 1, features(made, 0, len(made), span)


@dataclass
class Boosted:
    """Trees of splits (feature, bound) by level, their leaves, and a threshold for each kind."""

    trees: list[tuple[list[tuple[int, float]], np.ndarray]]
    prior: float
    thresholds: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        for splits, leaves in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for feature, bound in splits:
                leaf = 2 * leaf + (x[:, feature] > bound)
            total += leaves[leaf]
        return 1 / (1 + np.exp(-total))


#: Gradients are summed as whole multiples of this, so sums do not depend on the order of the rows.
UNIT = 2.0**-30


def binned(bounds: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates with the number of each feature's bin instead of its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("features"))
            bins = np.stack([np.searchsorted(b, c) for b, c in zip(bounds, x.T, strict=True)], axis=1).astype(np.uint8)
            rows = pa.array([r.tobytes() for r in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("held", "label")), rows], ["held", "label", "bins"])

    return run


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def bytes_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)


Trees = list[tuple[list[tuple[int, int]], np.ndarray]]


def leaf_of(bins: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    leaf = np.zeros(len(bins), np.int64)
    for feature, at in splits:
        leaf = 2 * leaf + (bins[:, feature] > at)
    return leaf


def raised(bins: np.ndarray, prior: float, trees: Trees) -> np.ndarray:
    total = np.full(len(bins), prior)
    for splits, leaves in trees:
        total += leaves[leaf_of(bins, splits)]
    return total


def slopes(prior: float, trees: Trees, splits: list[tuple[int, int]], features: int):
    """Sums of gradients and curvatures by (leaf of the tree that grows, feature, bin), in UNITs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = features * BINS << len(splits)
        g, h = np.zeros(size), np.zeros(size)
        for batch in batches:
            bins = bytes_of(batch)
            p = 1 / (1 + np.exp(-raised(bins, prior, trees)))
            slope = np.rint((batch.column("label").to_numpy() - p) / UNIT)
            bend = np.rint((p * (1 - p) + 1e-9) / UNIT)
            leaf = leaf_of(bins, splits) * features
            for f in range(features):
                cell = (leaf + f) * BINS + bins[:, f]
                g += np.bincount(cell, slope, size)
                h += np.bincount(cell, bend, size)
        at = np.flatnonzero(h)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), *(pa.array(v[at].astype(np.int64)) for v in (g, h))], ["cell", "g", "h"]
        )

    return run


def boost(rows: DataFrame, bounds: list[np.ndarray]) -> tuple[float, Trees] | None:
    """Logistic boosting with symmetric trees: one split a level, the best over the summed leaves.

    ``rows`` (``held``, ``label``, ``bins``) stay in their tasks; a level sums them by leaf, feature
    and bin, and only these sums, of a fixed number, reach the driver.
    """
    train = rows.where("held = 0")
    n, ones = train.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        return None
    rate = min(max(ones / n, 1e-3), 1 - 1e-3)
    prior, trees = float(np.log(rate / (1 - rate))), []
    features = len(bounds)
    for _ in range(ROUNDS):
        splits: list[tuple[int, int]] = []
        for level in range(DEPTH):
            made = train.mapInArrow(slopes(prior, trees, splits, features), "cell long, g long, h long")
            sums = made.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
            both = np.zeros((2, features * BINS << level))
            both[:, sums["cell"].to_numpy()] = [sums["g"].to_numpy() * UNIT, sums["h"].to_numpy() * UNIT]
            g, h = both.reshape(2, -1, features, BINS)
            gl, hl = np.cumsum(g, 2), np.cumsum(h, 2)
            gain = (gl**2 / (hl + 1) + (gl[..., -1:] - gl) ** 2 / (hl[..., -1:] - hl + 1)).sum(0)
            for f, own in enumerate(bounds):
                gain[f, len(own) :] = -np.inf
            f, at = divmod(int(np.argmax(gain)), BINS)
            splits.append((f, at))
        f, at = splits[-1]
        left, right = ((v[:, f, : at + 1].sum(1), v[:, f, at + 1 :].sum(1)) for v in (g, h))
        slope, bend = np.stack(left, 1).ravel(), np.stack(right, 1).ravel()
        trees.append((splits, RATE * slope / (bend + 1)))
    return prior, trees


def thresholds(rows: DataFrame, prior: float, trees: Trees) -> np.ndarray:
    """Each kind's threshold from all held-out candidates.

    Running counts by descending score are taken in two levels, inside slices of the score and over
    the slices, so no task sorts a kind.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = bytes_of(batch)
            score = 1 / (1 + np.exp(-raised(bins, prior, trees)))
            kind = bins[:, : len(KINDS)].argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(score), batch.column("label")], ["kind", "score", "label"])

    found = rows.where("held = 1").mapInArrow(scored, "kind long, score double, label int")
    found = found.groupBy("kind", "score").agg(F.count("*").alias("n"), F.sum("label").alias("right"))
    found = materialised(found.withColumn("slice", F.floor(F.col("score") * SLICES)))
    ahead = Window.partitionBy("kind").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("kind", "slice").orderBy(F.desc("score"))
    sums = found.groupBy("kind", "slice").agg(*[F.sum(c).alias(c) for c in ("n", "right")])
    sums = sums.select("kind", "slice", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in ("n", "right")])
    run = found.join(sums, ["kind", "slice"]).select(
        "kind", "score", *[(F.sum(c).over(inside) + F.col(f"{c}_ahead")).alias(c) for c in ("n", "right")]
    )
    good = (F.col("right") >= PRECISION * F.col("n")) & (F.col("n") >= LEAST_CHOSEN)
    lowest = run.where(good).groupBy("kind").agg(F.min("score").alias("lowest"))
    below = found.join(F.broadcast(lowest), "kind").groupBy("kind", "lowest").agg(  # a row a kind
        F.coalesce(F.max(F.when(F.col("score") < F.col("lowest"), F.col("score"))), F.lit(0.0)).alias("below")
    )
    out = np.full(len(KINDS), np.inf)
    for r in below.collect():
        out[r["kind"]] = min(r["lowest"], max(0.5, (r["lowest"] + r["below"]) / 2))
    return out


def fit(once: DataFrame) -> Boosted | None:
    """Trees from all candidates that are not held out, thresholds from all that are.

    ``once`` is a written table of ``held``, ``label`` and ``features``.
    """
    train = once.where("held = 0")
    first = train.select(F.size("features").alias("n")).first()
    if first is None:
        return None
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    # whole numbers: a feature's values are counted, not sorted
    cuts = train.agg(*[F.percentile(F.col("features")[k], shares) for k in range(first["n"])]).first()
    bounds = [np.unique(c) for c in cuts]
    # kinds are told apart by their own bins
    for kind in range(len(KINDS)):
        bounds[kind] = np.array([0.5])
    rows = materialised(once.mapInArrow(binned(bounds), "held int, label int, bins binary"))
    rows = rows.coalesce(max(1, rows.count() // TASK_ROWS))
    made = boost(rows, bounds)
    if made is None:
        return None
    prior, trees = made
    valued = [([(f, float(bounds[f][at])) for f, at in splits], leaves) for splits, leaves in trees]
    return Boosted(valued, prior, thresholds(rows, prior, trees))


def chosen(texts: Texts, model: Boosted | None) -> list[list[tuple[int, int, int, bool, float]]]:
    """(start, kind, end, base, score) of each text in bytes: base spans, then disjoint additions."""
    body, runs = texts.data.tobytes(), Runs(texts)
    found: list[list] = [[] for _ in range(len(texts.offsets) - 1)]
    taken = np.zeros(len(body) + 1, dtype=bool)

    def add(span: Span, base: bool, score: float) -> None:
        text = int(np.searchsorted(texts.offsets, span[0], "right")) - 1
        found[text].append((*span, base, score))
        taken[span[0] : span[2]] = True

    for span in base_spans(texts, runs, body):
        add(span, True, 1.0)
    loose = candidates(texts, runs, body) if model is not None else []
    loose = [s for s in loose if model.thresholds[s[1]] < np.inf and not taken[s[0] : s[2]].any()]
    if loose:
        at = np.searchsorted(texts.offsets, [s[0] for s in loose], "right")
        x = [features(body, int(texts.offsets[k - 1]), int(texts.offsets[k]), s) for k, s in zip(at, loose, strict=True)]
        score = model.scores(np.array(x))
        for i in np.argsort(-score, kind="stable"):
            span = loose[i]
            if score[i] >= model.thresholds[span[1]] and not taken[span[0] : span[2]].any():
                add(span, False, float(score[i]))
    return [sorted(f) for f in found]


def finder(model: Boosted | None, redact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span = pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64(), "base": pa.bool_(), "score": pa.float64()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
                rows, kept = [], []
                for text, found in enumerate(chosen(texts, model)):
                    low, high = int(texts.offsets[text]), int(texts.offsets[text + 1])
                    rows.append([
                        {"kind": KINDS[k], "start": int(points[a] - points[low]), "end": int(points[b] - points[low]),
                         "base": base, "score": score}
                        for a, k, b, base, score in found
                    ])
                    if redact:
                        parts, at = [], low
                        for a, k, b, *_ in found:
                            if b > at:
                                parts += [texts.data[at : max(a, at)].tobytes(), f"<{KINDS[k]}>".encode()]
                                at = b
                        kept.append((b"".join(parts) + texts.data[at:high].tobytes()).decode())
                arrays = [batch.column("_id").slice(texts.low, texts.high - texts.low), pa.array(rows, pa.list_(span))]
                names = ["_id", "found"]
                if redact:
                    arrays, names = [*arrays, pa.array(kept, pa.string())], [*names, "redacted"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text")):
            rows = list(lessons(texts))
            if rows:
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays(columns, ["name", "held", "label", "features"])


def personal_data(docs: DataFrame, text: str = "text", id_col: str = "doc_id", redact: bool = False) -> DataFrame:
    """``id_col`` and ``found``: spans (kind, start, end in code points, base, score) of each text by
    start and kind; with ``redact`` also the text with each span replaced by its kind.

    The trees learn from all different candidates. Null and empty texts have no spans; repeated rows are
    answered each; ids may be null or repeat; an empty table has no rows. Other columns are not read.
    """
    lessons_of = docs.select(F.col(text).alias("text")).mapInArrow(
        taught, "name long, held int, label int, features array<double>"
    )
    once = lessons_of.groupBy("name").agg(*[F.max(c).alias(c) for c in ("held", "label", "features")])
    model = fit(materialised(once.drop("name")))
    read = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text"))
    rest = "found array<struct<kind: string, start: long, end: long, base: boolean, score: double>>"
    schema = keyed(docs, id_col, rest + (", redacted string" if redact else ""))
    return read.mapInArrow(finder(model, redact), schema).withColumnRenamed("_id", id_col)


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> list[Column]:
    """The contract's columns beside the id."""
    base = F.filter("found", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [*map(number, KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")]
