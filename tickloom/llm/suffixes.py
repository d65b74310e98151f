"""Substring dedup by a sparse suffix array over bytes.

A window is anchored at the place among its first starts whose eight bytes have the least hash; its own
bytes alone decide that, so equal windows are anchored alike, and some eighty windows share an anchor.
The suffixes at the anchors, where their leading bytes occur more than once, are range-partitioned
by leading bytes with sampled splitters; every bucket sorts its suffixes by multikey quicksort and
compares neighbours, and the neighbours across bucket boundaries are compared too. The longest
match of a suffix bounds the windows that can recur, and these are settled one by one. Stretches that
recur whole are settled before (see ``repeats``); one of each kind takes part in the array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import repeats
from tickloom.llm.repeats import Content, Runs
from tickloom.llm.text import BASES, EIGHT, TAIL, keyed, signed
from tickloom.session import materialised

GRAM = 8
BUCKET_ROWS = 16384
SLICE = 1 << 17  # bytes whose arrays stay in a core's cache


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """``min(values[i : i + size])`` for every i that has so many values."""
    n, have = len(values) - size + 1, 1
    while 2 * have <= size:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:n], values[size - have :]) if have < size else values


def gram_ranks(data: np.ndarray, gram: int) -> np.ndarray:
    """32 bits of a hash of the ``gram`` bytes at each place that has so many."""
    padded = np.zeros(len(data) + EIGHT, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) - gram + 1, "<u8", padded, strides=(1,))
    if gram < EIGHT:
        eights = eights & TAIL[gram]
    return (eights * np.uint64(BASES[0]) >> np.uint64(32)).astype(np.uint32)


def first_equal(ranks: np.ndarray, least: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """The first place of ``at .. at + reach - 1`` whose rank is ``least[at]``."""
    found = at.copy()
    far = np.flatnonzero(ranks[at] != least[at])
    near = np.lib.stride_tricks.sliding_window_view(ranks, reach)
    for part in range(0, len(far), 1 << 13):
        some = far[part : part + (1 << 13)]
        found[some] += (near[at[some]] == least[at[some], None]).argmax(axis=1)
    return found


def byte_runs(texts, width: int) -> Runs:
    """The runs of all windows of ``width`` bytes.

    A window's anchor is the first of the least ranks at its first ``reach`` starts, its key the
    ``lead`` bytes from there, which the window holds whole.
    """
    offsets, n = texts.offsets, len(texts.data)
    reach = max(1, width * 2 // 5)
    lead = width - reach + 1
    first, last = offsets[:-1], offsets[1:] - width
    own = np.flatnonzero(first <= last)
    if not len(own):
        none = np.zeros(0, np.int64)
        return Runs(none, none.astype(np.uint64), none, none, none, (none.astype(np.uint64),) * 2)
    ranks = gram_ranks(texts.data, min(GRAM, lead))
    least = sliding_least(ranks, reach)
    # the anchor changes where a lesser rank comes in or the anchor goes out
    change = np.flatnonzero((least[1:] != least[:-1]) | (ranks[: len(least) - 1] == least[:-1])) + 1
    text = np.searchsorted(offsets, change, "right") - 1
    inside = (change > first[text]) & (change <= last[text])
    low, text = np.concatenate([first[own], change[inside]]), np.concatenate([own, text[inside]])
    order = np.argsort(low, kind="stable")
    low, text = low[order], text[order]
    high = np.minimum(np.append(low[1:], n) - 1, last[text])
    anchor = first_equal(ranks, least, low, reach)
    content = Content.of_bytes(texts.data)
    key = content.spans[0].of(anchor, anchor + lead)
    prints = content.of(low, high + width, anchor - low)
    shift = offsets[text]
    return Runs(text, key, low - shift, high - shift, anchor - shift, prints)


def multikey_quicksort(rows: np.ndarray) -> np.ndarray:
    """Order of byte strings given as rows of big-endian 64-bit words.

    Three ways by the word at hand: smaller and larger rows go on at this word, equal ones at the
    next. Small parts are finished by comparing rows.
    """
    n, depth = rows.shape
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        low, high, word = stack.pop()
        if word >= depth or high - low < 2:
            continue
        part = order[low:high]
        if high - low <= 64:
            order[low:high] = part[np.lexsort(rows[part, word:].T[::-1])]
            continue
        values = rows[part, word]
        pivot = np.partition(values, len(values) // 2)[len(values) // 2]
        less, more = values < pivot, values > pivot
        same = ~(less | more)
        order[low:high] = np.concatenate([part[less], part[same], part[more]])
        a = low + int(less.sum())
        b = a + int(same.sum())
        stack += [(low, a, word), (a, b, word + 1), (b, high, word)]
    return order


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that rows of two byte matrices have in common at their beginnings."""
    differ = a != b
    first = differ.argmax(axis=1)
    return np.where(differ.any(axis=1), first, a.shape[1])


STRETCH = "row long, low int, high int, alone boolean, shift int, stretch binary"
MATCHED = "row long, low int, high int, alone boolean"
EDGE = f"{MATCHED}, shift int, match int, bucket int, edge int, stretch binary"


def recurring(suffixes: DataFrame, rows: int, width: int, store: repeats.Store) -> DataFrame:
    """Runs (MATCHED) cut to the windows that the longest match of their suffix allows.

    ``suffixes`` has STRETCH, about ``rows`` of them; a suffix begins ``shift`` bytes into
    ``stretch``. Only what a bucket's edges need of the text leaves the bucket.
    """
    spark = suffixes.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, rows // BUCKET_ROWS + 1)
    # equal suffixes may fall into several buckets: row and low break their ties
    dealt = suffixes.repartitionByRange(buckets, F.expr("substring(stretch, shift + 1)"), "row", "low")
    words = -(-width // 8)
    names = [c.split()[0] for c in EDGE.split(", ")]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        shift, stretch = table["shift"].to_numpy().astype(np.int64), table["stretch"].to_pylist()
        suffix = [s[k : k + width] for s, k in zip(stretch, shift.tolist(), strict=True)]
        size = np.array([len(s) for s in suffix])
        raw = np.frombuffer(b"".join(s.ljust(8 * words, b"\0") for s in suffix), np.uint8).reshape(-1, 8 * words)
        order = multikey_quicksort(raw.view(">u8").astype(np.uint64))
        match = np.zeros(len(order), np.int64)
        for at in range(0, len(order) - 1, 4096):
            a, b = order[at : at + 4096], order[at + 1 : at + 4097]
            common = common_prefix(raw[a[: len(b)]], raw[b])
            match[a[: len(b)]] = np.maximum(match[a[: len(b)]], common)
            match[b] = np.maximum(match[b], common)
        match = np.minimum(match, size)
        edge = np.zeros(len(order), np.int32)
        edge[order[0]] += 1
        edge[order[-1]] += 2
        bucket = TaskContext.get().partitionId()
        low, high = (table[c].to_numpy().astype(np.int64) for c in ("low", "high"))
        # a window at low + k takes width - shift + k bytes of the suffix
        final = np.minimum(high, low + shift + match - width)
        for at in range(0, len(order), 2048):
            part = slice(at, at + 2048)
            last, ends = final[part], edge[part]
            keep = pa.array((last >= low[part]) | (ends > 0))
            yield pa.RecordBatch.from_arrays(
                [
                    *[table[c].combine_chunks().slice(at, 2048) for c in ("row", "low")],
                    pa.array(np.where(ends > 0, high[part], last).astype(np.int32)),
                    table["alone"].combine_chunks().slice(at, 2048),
                    pa.array(shift[part].astype(np.int32)),
                    pa.array(match[part].astype(np.int32)),
                    pa.array(np.full(len(ends), bucket, np.int32)),
                    pa.array(ends),
                    pa.array([s if e else None for s, e in zip(stretch[part], ends, strict=True)], pa.binary()),
                ],
                names,
            ).filter(keep)

    done = store.keep(dealt.mapInArrow(sort, EDGE))
    inner = done.where("edge = 0").select(*[c.split()[0] for c in MATCHED.split(", ")])
    # two rows a bucket, its first and its last suffix: compared with their neighbours' here
    edges = [r.asDict() for r in done.where("edge > 0").collect()]
    edges.sort(key=lambda r: (r["bucket"], r["edge"]))
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        if x["bucket"] != y["bucket"]:
            a, b = (bytes(r["stretch"])[r["shift"] : r["shift"] + width] for r in (x, y))
            n = min(len(a), len(b))
            pair = np.frombuffer(a[:n] + b[:n], np.uint8).reshape(2, n)
            common = int(common_prefix(pair[:1], pair[1:])[0]) if n else 0
            for r in (x, y):
                r["match"] = max(r["match"], common)
    if not edges:
        return inner
    for r in edges:
        r["high"] = min(r["high"], r["low"] + r["shift"] + r["match"] - width)
    names = [c.split()[0] for c in MATCHED.split(", ")]
    cut = spark.createDataFrame([tuple(r[c] for c in names) for r in edges], MATCHED)
    return inner.union(cut).where("low <= high")


def byte_dedup(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (remaining bytes), ``spans``.

    Removes every UTF-8 byte covered by a string of ``width`` bytes that also starts elsewhere, in
    any text or the same. ``spans`` lists what was removed as first byte and byte after the last.
    Null text counts as empty. Null and repeated ids are kept, a row each; repeated rows repeat each
    other's strings. Extra columns are ignored; an empty table gives no rows.
    """
    named = repeats.with_text(docs, id_col, text_col, [])
    first, second = repeats.Store(docs.sparkSession), repeats.Store(docs.sparkSession)
    found = repeats.find_runs(named, lambda texts: byte_runs(texts, width), SLICE)
    runs = repeats.candidates(found, first)
    # stretches that recur whole are settled; one of each kind stands for them in the suffix array
    whole, compared = repeats.settle(runs.where("NOT sure"), first)
    whole = second.keep(whole.union(runs.where("sure").select("row", "low", "high")))
    compared = second.keep(compared.select("row", "low", "high", "anchor", "alone"))
    first.clear()
    lists = compared.groupBy("row").agg(F.collect_list(F.struct("low", "high", "alone", "anchor")).alias("parts"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten()
            alone, anchor = flat.field(2), np.asarray(flat.field(3))
            done = 0
            for i, low, high in repeats.each_row(batch, 2):
                text = batch.column(1)[i].as_py() or b""
                at = anchor[done : done + len(low)]
                pieces = [text[a : b + width] for a, b in zip(low.tolist(), at.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.full(len(low), i))),
                        pa.array(low.astype(np.int32)),
                        pa.array(high.astype(np.int32)),
                        alone.slice(done, len(low)),
                        pa.array((at - low).astype(np.int32)),
                        pa.array(pieces, pa.binary()),
                    ],
                    ["row", "low", "high", "alone", "shift", "stretch"],
                )
                done += len(low)

    named = named.select("row", F.col("_text").cast("binary").alias("_text"))
    asked = named.join(lists, "row")
    suffixes = asked.select("row", "_text", "parts").mapInArrow(stretches, STRETCH)
    again = recurring(suffixes, compared.count(), width, second).groupBy("row").agg(
        F.collect_list(F.struct("low", "high", "alone")).alias("parts")
    )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = np.asarray(batch.column(2).flatten().field(2).to_numpy(zero_copy_only=False), bool)
            done = 0
            for i, low, high in repeats.each_row(batch, 2):
                data = np.frombuffer(batch.column(1)[i].as_py() or b"", np.uint8)
                at, run = repeats.exploded(low, high)
                w1, w2 = Content.of_bytes(data).of(at, at + width)
                for part in range(0, len(at), 1 << 16):
                    some = slice(part, part + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(signed(w1[some])),
                            pa.array(signed(w2[some])),
                            batch.column(0).take(pa.array(np.full(len(at[some]), i))),
                            pa.array(at[some].astype(np.int32)),
                            pa.array(alone[done : done + len(low)][run[some]]),
                        ],
                        ["w1", "w2", "row", "at", "alone"],
                    )
                done += len(low)

    asked_again = named.join(again, "row").select("row", "_text", "parts")
    single = repeats.equal_windows(
        asked_again.mapInArrow(windows, "w1 long, w2 long, row long, at int, alone boolean"), second
    )
    cuts = materialised(repeats.collected(whole.union(single)))
    second.clear()
    source = docs.select(
        repeats.name_of(id_col, text_col).alias("row"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text"),
        F.col(id_col).alias("_id"),
    )
    source = source.join(cuts, "row", "left").select("_id", "_text", "parts")
    schema = keyed(
        source, "_id",
        "n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,end:int>>",
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part_low in range(0, batch.num_rows, 512):
                part = batch.slice(part_low, 512)
                sizes, kept, spans = [], [], []
                for (_, low, high), text in zip(repeats.each_row(part, 2), part.column(1).to_pylist(), strict=True):
                    start, end = repeats.merged(low, high, width) if len(low) else (low, high)
                    pairs = list(zip(start.tolist(), end.tolist(), strict=True))
                    left, at = [], 0
                    for s, e in pairs:
                        left.append(text[at:s])
                        at = e
                    left.append(text[at:])
                    sizes.append(len(text))
                    kept.append(b"".join(left))
                    spans.append([{"start": s, "end": e} for s, e in pairs])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array([n - len(k) for n, k in zip(sizes, kept, strict=True)], pa.int64()),
                        pa.array([len(s) for s in spans], pa.int64()),
                        pa.array(kept, pa.binary()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    schema.names,
                )

    return source.mapInArrow(cut, schema).withColumnRenamed("_id", id_col)
