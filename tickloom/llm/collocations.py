"""Phrase collocations by dynamic itemset counting.

Documents are dealt into shards, which are scanned in a cycle. Words are counted from the first step
on; a longer phrase is counted from the step after both of its parts (without its last and without
its first word) have reached the threshold, and for one whole cycle from there, so every phrase is
counted once over all texts while lengths interleave: pairs start after the first shard, triples after
the second. Counting ends with the last cycle that began.

Which phrases are active is known to tasks by a *step table* of fixed size: a slot holds the first
step at which a phrase that hashes there became active, and a phrase starts at the latest step among
its slots. A slot is set once and never changes, so the start of a phrase is the same in every task and
step. Two phrases in one slot can only start a phrase early, which costs counts of a phrase that
turns out rare; no result depends on it, and phrases themselves are compared as text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.text import BYTE_CODES, LOWER, Spans, mix, slices, split, table
from tickloom.session import checkpoint_dir, materialised, removed

THRESHOLD = 10
COVER_PERCENT = 50
TOP = 2000
SHARDS = 4
MAX_WORDS = 3
#: Slots of a step table: its bytes, broadcast once a step.
SLOTS = 1 << 24
SALTS = 16
SLICE = 4 << 20
NEVER = 255

BLANK = table((0x20, 0x20), (0x09, 0x09))
#: The bytes that end a piece: line ends and . , ; : ! ?
STOP = table((0x0A, 0x0D), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
UND = "und"

Steps = tuple[np.ndarray, ...]


def fingerprints(column: pa.Array) -> np.ndarray:
    """A 64-bit value of every string, for slots only."""
    out = [np.zeros(0, np.uint64)]
    out += [Spans(BYTE_CODES[t.data]).of(t.offsets[:-1], t.offsets[1:]) for t in slices(column, SLICE)]
    return np.concatenate(out)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))))


def places(values: np.ndarray, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of each value."""
    top = np.uint64(n_slots - 1)
    return (values & top).astype(np.int64), ((values >> np.uint64(32)) & top).astype(np.int64)


def start_of(values: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """First step at which the phrases of these values have reached the threshold."""
    one, two = places(values, len(steps))
    return np.maximum(steps[one], steps[two])


class Slice:
    """The words of some texts, as numbers of (word, language), and which follow each other in a piece."""

    def __init__(self, data: np.ndarray, texts, langs: np.ndarray, names: pa.Array):
        data = LOWER[data]
        texts.data = data
        words = split(texts, BLANK | STOP)
        length = words.end - words.start
        offsets = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        inside = data[~(BLANK | STOP)[data]]
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(inside)]
        ).dictionary_encode()
        row = np.repeat(np.arange(len(words.counts)), words.counts)
        stops = np.cumsum(STOP[data])[words.start] if len(length) else np.zeros(0, np.int64)
        self.follows = (row[1:] == row[:-1]) & (stops[1:] == stops[:-1])
        codes = np.asarray(coded.indices, dtype=np.int64) * len(names) + langs[row]
        counts = np.bincount(codes, minlength=len(coded.dictionary) * len(names))
        found = np.flatnonzero(counts)
        renamed = np.zeros(len(counts), np.int64)
        renamed[found] = np.arange(len(found))
        self.unit, self.counts = renamed[codes], counts[found]
        self.text = coded.dictionary.cast(pa.large_string()).take(pa.array(found // len(names)))
        self.lang = names.take(pa.array(found % len(names)))
        self.value = joined(fingerprints(self.text), fingerprints(names)[found % len(names)])

    def phrases(self, units: list[np.ndarray]) -> pa.Array:
        """Words joined by spaces, then a line end and the language (words hold no line ends)."""
        parts = [self.text.take(pa.array(u)) for u in units]
        blank, end = (pa.scalar(x, pa.large_string()) for x in " \n")
        text = pc.binary_join_element_wise(*parts, blank) if len(parts) > 1 else parts[0]
        return pc.binary_join_element_wise(text, self.lang.take(pa.array(units[0])), end)


def counted(shown: Slice, step: int, shards: int, steps: Steps) -> Iterator[tuple[int, np.ndarray, list, np.ndarray]]:
    """(words, first step, units, counts) of the phrases that are active at a step."""
    n = np.int64(len(shown.counts))
    if step < shards:
        yield 1, np.zeros(n, np.int64), [np.arange(n)], shown.counts
    if n == 0 or not shown.follows.any():
        return
    ready = start_of(shown.value, steps[0])[shown.unit]
    at = np.flatnonzero(shown.follows)
    began = np.maximum(ready[at], ready[at + 1]).astype(np.int64)
    here = (began <= step) & (step < began + shards)
    if here.any():
        left, right = shown.unit[at[here]], shown.unit[at[here] + 1]
        code, first, many = np.unique(left * n + right, return_index=True, return_counts=True)
        yield 2, began[here][first], [code // n, code % n], many
    known = at[began <= step]
    if len(steps) < 2 or len(known) < 2:
        return
    second = np.full(len(shown.unit), NEVER, np.int64)
    pair = joined(shown.value[shown.unit[known]], shown.value[shown.unit[known + 1]])
    # slots may name a pair before its words are active, when no step counts what holds it
    second[known] = np.maximum(start_of(pair, steps[1]), began[began <= step])
    at = known[:-1][known[1:] == known[:-1] + 1]
    began = np.maximum(second[at], second[at + 1])
    here = (began <= step) & (step < began + shards)
    if here.any():
        at, began = at[here], began[here]
        pairs, inverse = np.unique(shown.unit[at] * n + shown.unit[at + 1], return_inverse=True)
        code, first, many = np.unique(inverse * n + shown.unit[at + 2], return_index=True, return_counts=True)
        pairs = pairs[code // n]
        yield 3, began[first], [pairs // n, pairs % n, code % n], many


def counter(step: int, shards: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = tuple(np.frombuffer(x, dtype=np.uint8) for x in shared.value)
        for batch in batches:
            langs = batch.column("lang").cast(pa.large_string()).dictionary_encode()
            lang = np.asarray(langs.indices, dtype=np.int64)
            for texts in slices(batch.column("text"), SLICE):
                shown = Slice(texts.data, texts, lang[texts.low : texts.high], langs.dictionary)
                for size, began, units, many in counted(shown, step, shards, steps):
                    yield pa.RecordBatch.from_arrays(
                        [
                            shown.phrases(units).cast(pa.string()),
                            pa.array(many.astype(np.int64)),
                            pa.array(np.full(len(many), size, np.int32)),
                            pa.array(began.astype(np.int32)),
                        ],
                        ["phrase", "n", "size", "start"],
                    )

    return run


def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, number of 64 slots, bits of both slots) of phrases that have reached the threshold."""
    for batch in batches:
        cut = [p.partition("\n") for p in batch.column("phrase").to_pylist()]
        size = np.asarray(batch.column("size"), dtype=np.int64)
        lang = fingerprints(pa.array([c[2] for c in cut], pa.string()))
        for k in range(1, MAX_WORDS):
            rows = np.flatnonzero(size == k)
            words = [cut[i][0].split(" ") for i in rows]
            value = None
            for place in range(k):
                own = joined(fingerprints(pa.array([w[place] for w in words], pa.string())), lang[rows])
                value = own if value is None else joined(value, own)
            for slot in places(value, SLOTS):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), k, np.int32)),
                        pa.array(slot >> 6),
                        pa.array((np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64)),
                    ],
                    ["size", "place", "bits"],
                )


def mark(steps: Steps, size: int, reached: pa.Table, step: int) -> bool:
    """Enter a step in the free slots of newly active phrases; whether there were phrases at all."""
    own = reached.filter(pc.equal(reached.column("size"), size))
    bits = np.ascontiguousarray(own.column("bits").to_numpy()).view(np.uint64)
    place = own.column("place").to_numpy()
    for bit in range(64):
        slot = place[(bits >> np.uint64(bit)) & np.uint64(1) == 1] * 64 + bit
        free = slot[steps[size - 1][slot] == NEVER]
        steps[size - 1][free] = step
    return len(place) > 0


def phrase_counts(docs: DataFrame, threshold: int, shards: int, text: str, lang: str) -> DataFrame:
    """``phrase`` (with its language behind a line end), ``size``, ``n``: all words, and every phrase
    of two or three words that both of its parts made active.

    Counts of each step are appended to one table bucketed by phrase, so that neither the test for the
    threshold nor the totals shuffle them again; a step tests only phrases whose cycle is running.
    """
    spark = docs.sparkSession
    home = checkpoint_dir(spark)
    path = f"{home}/shards-{uuid.uuid4().hex}"
    name = f"phrase_counts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UND)).alias("lang"),
        F.col(text).alias("text"),
        (F.monotonically_increasing_id() % shards).cast("int").alias("shard"),
    ).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    dealt = spark.read.schema("lang string, text string, shard int").parquet(path)
    steps = tuple(np.full(SLOTS, NEVER, np.uint8) for _ in range(MAX_WORDS - 1))
    step, last = 0, shards
    while step < last:
        shared = spark.sparkContext.broadcast([s.tobytes() for s in (steps if step > 1 else steps[:1])])
        made = dealt.where(F.col("shard") == step % shards).select("lang", "text").mapInArrow(
            counter(step, shards, shared), "phrase string, n long, size int, start int"
        )
        made = made.repartition(buckets, "phrase").groupBy("phrase", "size", "start").agg(F.sum("n").alias("n"))
        (
            made.select("phrase", "n", F.lit(step).alias("step"), "size", "start")
            .write.partitionBy("size", "start")
            .bucketBy(buckets, "phrase")
            .option("path", f"{home}/{name}")
            .mode("append")
            .saveAsTable(name)
        )
        shared.destroy()
        now = F.sum(F.when(F.col("step") == step, F.col("n")).otherwise(0))
        reached = (
            spark.table(name)
            .where((F.col("size") < MAX_WORDS) & (F.col("start") > step - shards))
            .groupBy("phrase", "size")
            .agg(F.sum("n").alias("n"), now.alias("now"))
            .where((F.col("n") >= threshold) & (F.col("n") - F.col("now") < threshold))
            .select("phrase", "size")
            .mapInArrow(slots_of, "size int, place long, bits long")
            .groupBy("size", "place")
            .agg(F.bit_or("bits").alias("bits"))
            .toArrow()
        )
        for size in range(1, MAX_WORDS):
            if mark(steps, size, reached, step + 1):
                last = max(last, step + 1 + shards)
        step += 1
    totals = spark.table(name).groupBy("phrase", "size").agg(F.sum("n").alias("n"))
    kept = materialised(totals.where((F.col("size") == 1) | (F.col("n") >= threshold)))
    spark.sql(f"DROP TABLE {name}")
    removed(spark, path)
    removed(spark, f"{home}/{name}")
    return kept


def words_of(c: str) -> F.Column:
    return F.split(F.substring_index(c, "\n", 1), " ", -1)


def keyed(words: F.Column) -> F.Column:
    """A phrase of the same language as the candidate's."""
    return F.concat(F.array_join(words, " "), F.lit("\n"), F.col("lang"))


def collocations(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    cover_percent: int = COVER_PERCENT,
    top: int = TOP,
    shards: int = SHARDS,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The ``top`` phrases of two and three words of each language, by their weakest cut.

    Texts lose the case of A-Z and are cut at line ends and ``. , ; : ! ?`` into pieces, pieces at
    blanks into words. A phrase is a candidate with ``threshold`` occurrences inside pieces; its score is
    ``floor(1000000 a a / (l r))`` at the cut where that is least (the first of equal ones), in whole
    numbers of 38 digits. A candidate inside a longer candidate that has ``cover_percent`` of its
    occurrences is left out. Columns: lang, rank, phrase, a, l, r, n, score.

    Null texts and empty ones hold no words; a null language is ``und``. Repeated rows count as often as
    they occur. An empty table has no rows. Other columns, whatever their names, are not read.
    """
    counts = phrase_counts(docs, threshold, shards, text, lang)
    counts = counts.withColumn("lang", F.expr("substring(phrase, instr(phrase, '\n') + 1)"))
    total = counts.where("size = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    found = counts.where("size > 1").select("phrase", "lang", "size", "n")
    w = words_of("phrase")
    part = lambda k, side, words: F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), keyed(words).alias("part"))
    cuts = F.when(
        F.col("size") == 2,
        F.array(part(1, "l", F.slice(w, 1, 1)), part(1, "r", F.slice(w, 2, 1))),
    ).otherwise(
        F.array(
            part(1, "l", F.slice(w, 1, 1)), part(1, "r", F.slice(w, 2, 2)),
            part(2, "l", F.slice(w, 1, 2)), part(2, "r", F.slice(w, 3, 1)),
        )
    )
    parts = found.select("phrase", "lang", F.col("n").alias("a"), F.explode(cuts).alias("cut")).select(
        "phrase", "lang", "a", "cut.*"
    )
    sizes = counts.where(F.col("n") >= threshold).select(F.col("phrase").alias("part"), F.col("n").alias("f"))
    score = "(CAST(a AS DECIMAL(16, 0)) * CAST(a AS DECIMAL(16, 0)) * 1000000) DIV (CAST(l AS DECIMAL(16, 0)) * CAST(r AS DECIMAL(16, 0)))"
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("f"))).alias(side)
    cut = (
        parts.join(sizes, "part")
        .groupBy("phrase", "lang", "a", "k")
        .agg(at("l"), at("r"))
        .withColumn("score", F.expr(score))
        .groupBy("phrase", "lang", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
        .select("phrase", "lang", "a", "least.score", "least.l", "least.r")
    )
    longer = found.where("size = 3").select(
        F.explode(F.array(keyed(F.slice(w, 1, 2)), keyed(F.slice(w, 2, 2)))).alias("phrase"), "n"
    )
    longer = longer.groupBy("phrase").agg(F.max("n").alias("cover"))
    kept = cut.join(longer, "phrase", "left").where(
        F.coalesce(100 * F.col("cover") < cover_percent * F.col("a"), F.lit(True))
    )
    kept = kept.select("lang", F.substring_index("phrase", "\n", 1).alias("phrase"), "a", "l", "r", "score")
    return ranked(kept, top).join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
        F.col("total").alias("n"), "score",
    )


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language: first of each of some salts, then of what these leave.

    Both windows keep ``top`` rows of a task before they shuffle, so no task holds a language.
    """
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = found.withColumn("salt", salt).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    )
    first = first.where(F.col("rank") <= top).drop("salt", "rank")
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return out.where(F.col("rank") <= top)
