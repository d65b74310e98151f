"""Substring dedup by recompression: remove words covered by a window that occurs elsewhere too.

Words become symbols; runs of one symbol are named by symbol and length; then, round by round,
symbols fall into two classes by a bit of their name and every pair of a first-class and a
second-class symbol becomes one symbol. Names are fingerprints of what they stand for, so all tasks
give equal substrings equal names without exchanging any. Each symbol carries the stretch of words
that decided it: inside an equal stretch of another text the same symbol arises. A window's anchor
is that of the highest-level symbols decided inside the window whose name has the least hash; symbols shared between
places lead to the repeats, which are verified on the words (see ``repeats``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import repeats
from tickloom.llm.repeats import Content, Runs
from tickloom.llm.text import WHITE, keyed, mix, signed, slices, split, word_codes
from tickloom.session import materialised

ROUNDS = 6
SALT = np.uint64(0xA0761D6478BD642F)


def salt(k: int) -> np.uint64:
    return np.uint64(k * int(SALT) % (1 << 64))


def least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the first least value in each range ``low .. high``, from tables of doubling spans."""
    out = np.zeros(len(low), np.int64)
    if not len(low):
        return out
    depth = np.floor(np.log2(high - low + 1)).astype(np.int64)
    table = np.arange(len(values))
    for k in range(int(depth.max()) + 1):
        rows = np.flatnonzero(depth == k)
        a, b = table[low[rows]], table[high[rows] - (1 << k) + 1]
        out[rows] = np.where(values[a] <= values[b], a, b)
        a, b = table[: -(1 << k)], table[1 << k :]
        table = np.where(values[a] <= values[b], a, b)
    return out


class Symbols:
    """Symbols of one level: name, first word, and the stretch ``begin .. end`` that decides it."""

    def __init__(self, name, start, begin, end):
        self.name, self.start, self.begin, self.end = name, start, begin, end


def levels(codes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """All levels over texts whose words are ``first[i] .. first[i+1]``.

    At the ends of a text the deciding stretch reaches past it, so no window holds such a symbol.
    """
    n = len(codes)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    front, back = first[:-1][text] - 1, first[1:][text] + 1
    at = np.arange(n)
    out = [Symbols(codes, at, at, at + 1)]
    for level in range(rounds + 1):
        s = out[-1]
        m = len(s.name)
        if m == 0:
            break
        owner = text[s.start]
        last = np.ones(m, bool)
        last[:-1] = owner[1:] != owner[:-1]
        opening = np.ones(m, bool)
        opening[1:] = last[:-1]
        before = np.where(opening, front[s.start], np.roll(s.begin, 1))
        after = np.where(last, back[s.start], np.roll(s.end, -1))
        if level == 0:
            head = np.ones(m, bool)
            head[1:] = (s.name[1:] != s.name[:-1]) | opening[1:]
            i = np.flatnonzero(head)
            j = np.append(i[1:], m) - 1
            size = (j - i + 1).astype(np.uint64)
            name = np.where(size > 1, mix(s.name[i] + size * SALT), s.name[i])
            out.append(Symbols(name, s.start[i], before[i], after[j]))
            continue
        left = (mix(s.name + salt(level)) & np.uint64(1)).astype(bool)
        pair = np.zeros(m, bool)
        pair[:-1] = left[:-1] & ~left[1:] & ~last[:-1]
        inner = np.zeros(m, bool)
        inner[1:] = pair[:-1]
        i = np.flatnonzero(~inner)
        two = pair[i]
        j = i + two
        name = np.where(two, mix(s.name[i] * SALT + mix(s.name[j] + SALT)), s.name[i])
        begin = np.where(two | left[i], s.begin[i], before[i])
        end = np.where(two, s.end[j], np.where(left[i], after[i], s.end[i]))
        out.append(Symbols(name, s.start[i], begin, end))
    return out


def word_runs(texts, width: int) -> Runs:
    """The runs of all windows of ``width`` words."""
    words = split(texts, WHITE)
    codes = word_codes(texts.data, words)
    n = len(codes)
    text = np.repeat(np.arange(len(words.first) - 1), words.counts)
    starts = np.flatnonzero(np.arange(n) + width <= words.first[1:][text]) if n else np.zeros(0, np.int64)
    key, place = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    open_ = starts
    for level, s in reversed(list(enumerate(levels(codes, words.first)))):
        i = np.searchsorted(s.begin, open_, "left")
        j = np.searchsorted(s.end, open_ + width, "right") - 1
        fits = i <= j
        some, best = open_[fits], least(mix(s.name ^ SALT), i[fits], j[fits])
        key[some] = mix(s.name[best] + salt(level + 1))
        place[some] = s.start[best]
        open_ = open_[~fits]
    head = np.ones(len(starts), bool)
    a, b = starts[:-1], starts[1:]
    head[1:] = (b != a + 1) | (place[b] != place[a]) | (key[b] != key[a]) | (text[b] != text[a])
    i = np.flatnonzero(head)
    low = starts[i]
    high = starts[np.append(i[1:], len(starts)) - 1]
    shift = words.first[:-1][text[low]]
    prints = Content(codes, word_codes(texts.data, words, 1)).of(low, high + width, place[low] - low)
    return Runs(text[low], key[low], low - shift, high - shift, place[low] - shift, prints)


def substring_dedup(
    docs: DataFrame,
    width: int = 35,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed``, ``kept`` (remaining words joined by one space), ``spans``.

    Removes every word covered by a window of ``width`` words whose sequence also starts elsewhere,
    in any text or the same. Words are maximal runs of anything but ASCII white space, unchanged.
    ``spans`` lists what was removed as first word and word after the last. Null and empty texts
    have no words. Null and repeated ids are kept, a row each; repeated rows repeat each other's
    windows. Columns named in ``carry`` follow, unchanged; other extra columns are ignored; an empty
    table gives no rows.
    """
    named = repeats.with_text(docs, id_col, text_col, [])
    found = repeats.find_runs(named, lambda texts: word_runs(texts, width))
    first, second = repeats.Store(docs.sparkSession), repeats.Store(docs.sparkSession)
    runs = repeats.candidates(found, first)
    whole, compared = repeats.settle(runs.where("NOT sure"), first)
    whole = second.keep(whole.union(runs.where("sure").select("row", "low", "high")))
    compared = second.keep(compared.select("row", "low", "high", "alone"))
    first.clear()
    lists = compared.groupBy("row").agg(
        F.collect_list(F.struct("low", "high", "alone")).alias("parts")
    )
    asked = named.join(lists, "row").select("row", "_text", "parts")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(repeats.each_row(batch, 2))
            alone = np.asarray(batch.column(2).flatten().field(2).to_numpy(zero_copy_only=False), bool)
            done = 0
            for texts in slices(batch.column(1)):
                words = split(texts, WHITE)
                content = Content(*(word_codes(texts.data, words, k) for k in (0, 1)))
                for k in range(texts.low, texts.high):
                    i, low, high = rows[k]
                    at, run = repeats.exploded(low, high)
                    shift = words.first[k - texts.low]
                    w1, w2 = content.of(at + shift, at + shift + width)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(signed(w1)),
                            pa.array(signed(w2)),
                            batch.column(0).take(pa.array(np.full(len(at), i))),
                            pa.array(at.astype(np.int32)),
                            pa.array(alone[done : done + len(low)][run]),
                        ],
                        ["w1", "w2", "row", "at", "alone"],
                    )
                    done += len(low)

    single = repeats.equal_windows(asked.mapInArrow(windows, "w1 long, w2 long, row long, at int, alone boolean"), second)
    cuts = materialised(repeats.collected(whole.union(single)))
    second.clear()
    also = [f"_c{k}" for k in range(len(carry))]
    kept_rows = repeats.with_text(
        docs, id_col, text_col,
        [F.col(id_col).alias("_id"), *[F.col(c).alias(a) for c, a in zip(carry, also, strict=True)]],
    ).join(cuts, "row", "left")
    kept_rows = kept_rows.select("_id", "_text", "parts", *also)
    schema = keyed(
        kept_rows, "_id", "n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>"
    )
    for a in also:
        schema = schema.add(a, kept_rows.schema[a].dataType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part_low in range(0, batch.num_rows, 512):
                part = batch.slice(part_low, 512)
                n_words, n_removed, kept, spans = [], [], [], []
                for (i, low, high), text in zip(
                    repeats.each_row(part, 2), part.column(1).to_pylist(), strict=True
                ):
                    words = (text or "").encode().split()
                    start, end = repeats.merged(low, high, width) if len(low) else (low, high)
                    left, at = [], 0
                    for s, e in zip(start.tolist(), end.tolist(), strict=True):
                        left += words[at:s]
                        at = e
                    left += words[at:]
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode())
                    spans.append([{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_removed, pa.int64()),
                        pa.array(kept, pa.string()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        *[part.column(3 + k) for k in range(len(also))],
                    ],
                    schema.names,
                )

    out = kept_rows.mapInArrow(cut, schema)
    main = [F.col("_id").alias(id_col), "n_words", "n_removed", "kept", "spans"]
    return out.select(*main, *[F.col(a).alias(c) for c, a in zip(carry, also, strict=True)])
