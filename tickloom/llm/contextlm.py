"""Language-model scores: context-tree weighting over bytes, beside add-one word frequencies.

A byte is eight binary decisions. Each decision (bit position and the bits before it) owns a
context tree over the preceding bytes, three deep. Every node estimates by Krichevsky-Trofimov
from its counts; a node mixes its own estimate with its children's by the weights that context-tree
weighting assigns them from the probability each gives the training bytes. After training the
weights are fixed, so a byte's probability is a table lookup, and the sum of log2 over a text is
its code length.

Contexts and predictions name every byte in full. Strings of four bytes are counted and stay
distributed; a tree's contexts that end in the same two bytes are weighted in one group (at most
65,536 numbers), and what the two upper levels need of them is one line per last byte and decision
(65,280 at most), the only thing that reaches the driver. Strings and words with a share of at least
2**-20 and 2**-18 of all are broadcast, so at most 2**20 and 2**18; the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import LOWER, WHITE, keyed as with_id, signed, slices, split, word_codes
from tickloom.session import materialised

DEPTH = 3
#: Contexts of ``predictions``, which holds a whole tree of a small alphabet.
CLASSES = 32
CELLS = CLASSES**DEPTH * 256
FREQUENT = 1 << 18
FREQUENT_STRINGS = 1 << 20
#: Stands for what is before a text: a capital, which no lower-cased text holds.
START = ord("A")
LN2 = np.log(2.0)


def gammaln(x: np.ndarray) -> np.ndarray:
    """Log gamma for positive arguments: the recurrence up to 8, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    low = np.ones_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        low[small] *= y[small]
        y[small] += 1
    inverse = 1 / y
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(low)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of that many zeros and ones."""
    return (
        gammaln(zeros + 0.5) + gammaln(ones + 0.5) - gammaln(zeros + ones + 1.0) - 1.1447298858494002
    )


def context_codes(texts) -> np.ndarray:
    """Each byte with the three bytes before it in its text, the nearest next to it."""
    code = texts.data.astype(np.uint32)
    for back in range(1, DEPTH + 1):
        before = np.full(len(code), START, np.uint32)
        before[back:] = texts.data[:-back]
        for at in range(back):
            start = texts.offsets[:-1] + at
            before[start[start < texts.offsets[1:]]] = START
        code |= before << np.uint32(8 * back)
    return code


def lower(texts):
    texts.data = LOWER[texts.data]
    return texts


def decisions(counts: np.ndarray) -> np.ndarray:
    """Zeros and ones of the 255 decisions of a byte, most significant bit first, from counts of bytes."""
    m = len(counts)
    parts = [counts.reshape(m, 1 << bit, 2, 128 >> bit).sum(axis=3) for bit in range(8)]
    return np.concatenate(parts, axis=1).astype(float)


def own_log(seen: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov log probability of the decisions, 0 where none was seen."""
    out = np.zeros(seen.shape[:-1])
    some = seen.sum(axis=-1) > 0
    out[some] = kt_log(seen[some][:, 0], seen[some][:, 1])
    return out


def weigh(seen: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's weighted log probability and the share of its own estimate, from its children's sum."""
    own = own_log(seen)
    weighted = np.logaddexp(own, below) - LN2
    return weighted, np.exp(own - LN2 - weighted)


def upper(seen: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the two upper levels give to every last byte's decisions: a part and the share left over.

    ``seen`` and ``below`` hold, per last byte, the decisions' counts and the sum of the weighted
    logs of the contexts one byte longer.
    """
    weighted, share = weigh(seen, below)
    _, root = weigh(seen.sum(axis=0), weighted.sum(axis=0))
    part = root * estimate(seen.sum(axis=0)) + (1 - root) * share * estimate(seen)
    return part, (1 - root) * (1 - share)


def lower_levels(seen: np.ndarray, part: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 of the mixed probability of every byte, in the contexts that share their last two bytes."""
    _, share = weigh(seen.sum(axis=0), own_log(seen).sum(axis=0))
    mixed = part + left * (share * estimate(seen.sum(axis=0)) + (1 - share) * estimate(seen))
    out = np.zeros((len(seen), 256))
    for bit in range(8):
        one = mixed[:, (1 << bit) - 1 : (2 << bit) - 1]
        pair = np.stack([np.log10(1.0 - one), np.log10(one)], axis=2).reshape(len(seen), -1)
        out += np.repeat(pair, 128 >> bit, axis=1)
    return out


def predictions(counts: np.ndarray) -> np.ndarray:
    """log10 of the mixed probability of every cell of a tree over ``CLASSES`` symbols, from all counts."""
    full = counts.reshape(CLASSES, CLASSES, CLASSES, 256)  # the nearest symbol last
    seen = [[decisions(full[:, two, one]) for two in range(CLASSES)] for one in range(CLASSES)]
    below = np.array([sum(weigh(c.sum(axis=0), own_log(c).sum(axis=0))[0] for c in row) for row in seen])
    part, left = upper(np.array([sum(c.sum(axis=0) for c in row) for row in seen]), below)
    out = np.empty(full.shape, np.float32)
    for one, row in enumerate(seen):
        for two, c in enumerate(row):
            out[:, two, one] = lower_levels(c, part[one], left[one])
    return out.ravel()


def estimate(counts: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability of a one."""
    return (counts[..., 1] + 0.5) / (counts[..., 0] + counts[..., 1] + 1.0)


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order and the sum of each one's ``n``."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]]))
    return codes[at], np.add.reduceat(n[order], at) if len(at) else n


def string_counts(docs: DataFrame) -> DataFrame:
    """Strings of four bytes of all texts (``g``) and how often each occurs where ``_learn`` holds (``n``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False)
            for texts in slices(batch.column(0)):
                fresh = context_codes(lower(texts))
                taught = np.repeat(learn[texts.low : texts.high], np.diff(texts.offsets))
                parts = [(codes, n)]
                for of, weight in ((fresh[taught], 1), (fresh[~taught], 0)):
                    of.sort()
                    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), of[1:] != of[:-1]]))
                    parts.append((of[at], np.diff(np.append(at, len(of))) * weight))
                codes, n = summed(np.concatenate([c for c, _ in parts]), np.concatenate([k for _, k in parts]))
                if len(codes) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], ["g", "n"])
                    codes, n = codes[:0], n[:0]
        if len(codes):
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], ["g", "n"])

    return docs.select("_text", "_learn").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def counts_of(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of bytes after each context of a group, and each row's context and byte there."""
    g = group["g"].to_numpy()
    firsts, context = np.unique(g >> 24, return_inverse=True)
    counts = np.zeros((len(firsts), 256), np.int64)
    counts[context, g & 255] = group["n"].to_numpy()
    return counts, context, g & 255


def string_scores(strings: DataFrame) -> DataFrame:
    """``strings`` with ``p``, log10 of the tree's probability of the last byte after the others."""
    by_end = strings.withColumn("e", F.shiftright("g", 8).bitwiseAND(65535)).groupBy("e")

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        seen = decisions(counts_of(group)[0])
        whole = seen.sum(axis=0)
        node = np.flatnonzero(whole.sum(axis=1))
        weighted, _ = weigh(whole, own_log(seen).sum(axis=0))
        return pd.DataFrame(
            {"c": int(group["e"].iloc[0]) & 255, "node": node, "z": whole[node, 0], "o": whole[node, 1], "w": weighted[node]}
        )

    # Summed as decimals: a sum of floats depends on its order.
    ends = by_end.applyInPandas(sums, "c int, node int, z double, o double, w double").groupBy("c", "node").agg(
        F.sum("z").alias("z"), F.sum("o").alias("o"), F.sum(F.col("w").cast("decimal(28,12)")).cast("double").alias("w")
    ).toPandas()  # at most 256 times 255 rows
    seen, below = np.zeros((256, 255, 2)), np.zeros((256, 255))
    at = ends["c"].to_numpy(), ends["node"].to_numpy()
    seen[(*at, 0)], seen[(*at, 1)], below[at] = ends["z"], ends["o"], ends["w"]
    part, left = upper(seen, below)

    def scores(group: pd.DataFrame) -> pd.DataFrame:
        counts, context, byte = counts_of(group)
        last = int(group["e"].iloc[0]) & 255
        table = lower_levels(decisions(counts), part[last], left[last])
        return pd.DataFrame({"g": group["g"], "n": group["n"], "p": table[context, byte].astype(np.float32)})

    return by_end.applyInPandas(scores, "g long, n long, p float")


class Lookup:
    """Values of the commonest strings: one probe for nearly all bytes, a search for displaced strings."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, values: np.ndarray) -> None:
        order = np.lexsort((codes, -n))
        codes, values = codes[order].astype(np.uint32), values[order].astype(np.float32)
        self.bits = max(12, (4 * len(codes)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.values = np.full(1 << self.bits, np.nan, np.float32)
        place = self.place(codes)
        first = np.unique(place, return_index=True)[1]
        self.keys[place[first]], self.values[place[first]] = codes[first], values[first]
        rest = np.setdiff1d(np.arange(len(codes)), first)
        rest = rest[np.argsort(codes[rest])]
        self.more, self.more_values = codes[rest], values[rest]

    def place(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435769)) >> np.uint32(32 - self.bits)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Value of each code, NaN where it is not held."""
        place = self.place(codes)
        found = self.values[place]
        found[self.keys[place] != codes] = np.nan
        if len(self.more):
            miss = np.flatnonzero(np.isnan(found))
            at = np.minimum(np.searchsorted(self.more, codes[miss]), len(self.more) - 1)
            hit = self.more[at] == codes[miss]
            found[miss[hit]] = self.more_values[at[hit]]
        return found


def distinct_words(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word fingerprint, count) of the distinct words of each text."""
    words = split(texts, WHITE)
    codes = word_codes(texts.data, words)
    text = np.repeat(np.arange(len(texts.offsets) - 1), words.counts)
    order = np.lexsort((codes, text))
    codes, text = codes[order], text[order]
    new = np.ones(len(codes), dtype=bool)
    new[1:] = (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], codes[at], np.diff(np.append(at, len(codes)))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Words of all texts (``w``, a fingerprint) and how often each occurs (``c``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            for texts in slices(batch.column(0)):
                words = split(lower(texts), WHITE)
                codes, n = np.unique(word_codes(texts.data, words), return_counts=True)
                held.append(pd.DataFrame({"w": signed(codes), "c": n.astype(np.int64)}))
                size += len(codes)
                if size > 1 << 21:
                    yield pa.RecordBatch.from_pandas(pd.concat(held).groupby("w", as_index=False).sum())
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pandas(pd.concat(held).groupby("w", as_index=False).sum())

    return docs.select(text_col).mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def score(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Score every text with a model of the texts where ``learn`` holds.

    Returns ``id_col``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (words, add-one),
    ``score`` (log10 probability under the tree) and ``bits_per_byte`` (its code length a byte, null
    for an empty text). A-Z is lower-cased. Null text counts as empty: one token, the end. Nothing
    to learn from gives uniform estimates. Rows whose id is null or repeated are scored one by one.
    Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn")
    )
    taught = keyed.where("_learn")
    vocabulary = materialised(word_counts(taught, "_text"))
    facts = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = taught.count()
    tokens, distinct = facts["n"] + ends, facts["v"] + (ends > 0)
    whole = np.log10(float(tokens + distinct + 1))
    frequent = vocabulary.where(F.col("c") * FREQUENT >= max(tokens, 1)).toArrow()
    order = np.argsort(frequent["w"].to_numpy())
    common = (frequent["w"].to_numpy()[order], frequent["c"].to_numpy()[order])
    strings = materialised(string_scores(materialised(string_counts(keyed))))
    bytes_taught = strings.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * FREQUENT_STRINGS >= max(bytes_taught, 1)
    held = strings.where(often).toArrow()
    table = Lookup(held["g"].to_numpy(), held["n"].to_numpy(), held["p"].to_numpy())
    shared = spark.sparkContext.broadcast((common, table))

    rows = keyed.select("_id", "_text")
    schema = with_id(
        rows, "_id", "row long, n_words long, n_known long, sum double, score double, n_bytes long, "
        "w array<long>, n array<int>, g array<long>, k array<int>",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, counted), table = shared.value
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for texts in slices(batch.column(1)):
                lower(texts)
                m = len(texts.offsets) - 1
                text, codes, n = distinct_words(texts)
                codes = signed(codes)
                at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                gain = n[hit] * np.log10(counted[at[hit]] + 1.0)
                strings = context_codes(texts)
                gained = table.find(strings)
                missed = np.flatnonzero(np.isnan(gained))
                gained[missed] = 0.0
                running = np.zeros(len(texts.data) + 1)
                np.cumsum(gained, out=running[1:], dtype=float)
                of = np.searchsorted(texts.offsets, missed, "right") - 1
                joined, times = np.unique((of << 32) | strings[missed], return_counts=True)
                from_string = np.searchsorted(joined, np.arange(m + 1) << 32).astype(np.int32)
                rare = ~hit
                place = np.zeros(m + 1, np.int32)
                np.cumsum(np.bincount(text[rare], minlength=m), out=place[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.low, m),
                        pa.array(np.arange(row, row + m)),
                        pa.array(np.bincount(text, n, minlength=m).astype(np.int64)),
                        pa.array(np.bincount(text[hit], n[hit], minlength=m).astype(np.int64)),
                        pa.array(np.bincount(text[hit], gain, minlength=m).astype(float)),
                        pa.array(np.diff(running[texts.offsets])),
                        pa.array(np.diff(texts.offsets)),
                        pa.ListArray.from_arrays(pa.array(place), pa.array(codes[rare])),
                        pa.ListArray.from_arrays(pa.array(place), pa.array(n[rare].astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(from_string), pa.array(joined & 0xFFFFFFFF)),
                        pa.ListArray.from_arrays(pa.array(from_string), pa.array(times.astype(np.int32))),
                    ],
                    schema.names,
                )
                row += m

    scored = materialised(rows.mapInArrow(run, schema))
    shared.destroy()
    rare = scored.select("row", F.explode(F.arrays_zip("w", "n")).alias("z")).select("row", "z.w", "z.n")
    found = (
        rare.join(vocabulary.where(F.col("c") * FREQUENT < max(tokens, 1)), "w")
        .groupBy("row")
        .agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("extra"))
    )
    missed = scored.select("row", F.explode(F.arrays_zip("g", "k")).alias("z")).select("row", "z.g", "z.k")
    gained = (
        missed.join(strings.where(~often), "g")
        .groupBy("row")
        .agg(F.sum((F.col("k") * F.col("p").cast("double")).cast("decimal(28,12)")).cast("double").alias("gained"))
    )
    score = F.col("score") + F.coalesce("gained", F.lit(0.0))
    end_gain = float(np.log10(ends + 1.0))
    n_tokens = F.col("n_words") + 1
    return scored.join(found, "row", "left").join(gained, "row", "left").select(
        F.col("_id").alias(id_col),
        n_tokens.alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("extra", F.lit(0.0)) + F.lit(end_gain) - n_tokens * F.lit(whole)).alias(
            "base_score"
        ),
        score.alias("score"),
        F.when(F.col("n_bytes") > 0, -score * F.lit(3.321928094887362) / F.col("n_bytes")).alias(
            "bits_per_byte"
        ),
    )
