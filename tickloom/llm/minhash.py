"""Near-duplicate documents by SuperMinHash.

Every element of a set has its own random permutation of the signature's places. Level after
level, an element offers (level + a random fraction) to the next place of its permutation; a place
keeps the least offer. Offers of a level exceed all of the level before, so a set is done once
every place holds an offer of the levels seen: large sets after one level, small ones after a few.
The places of one set are correlated, which lowers the variance of the estimate.

Equal sets are collapsed first. Of the rest, documents that share a band of the signature are
candidates; a pair is linked only on its full sets. First everything in a band is compared with its
smallest document (groups of near copies need no pair but these); what shares a band and is still
apart is compared pair by pair, in blocks, by a finer sketch and then on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.text import LOWER, WHITE, keyed, mix, shingles, signed, slices, split, word_codes
from tickloom.session import materialised

PLACES = 128
BAND = 4
FRACTION_BITS = 25
#: An estimate this far below the threshold rules a pair out: five deviations and more.
SLACK = 0.22
#: Bins of the finer sketch that is compared before whole texts are, and the deviations it is given.
BINS = 512
DEVIATIONS = 5.0
BLOCK = 256
GROUP_ROWS = 4096


def super_minhash(elements: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Signatures of consecutive sets of 64-bit elements; a set is ``place[i] .. place[i+1]``.

    A value holds the level above ``FRACTION_BITS`` random bits. An empty set keeps the maximum.
    """
    n_sets = len(place) - 1
    signature = np.full(n_sets * PLACES, np.iinfo(np.uint32).max, np.uint32)
    owner = np.repeat(np.arange(n_sets), np.diff(place))
    state = mix(elements)
    swaps = None
    for level in range(PLACES):
        if not len(owner):
            break
        draw = mix(state + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        fraction = (draw >> np.uint64(64 - FRACTION_BITS)).astype(np.uint32)
        pick = level + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(PLACES - level) >> np.uint64(32)).astype(np.int64)
        if swaps is None:
            slot = pick
        else:
            rows = np.arange(len(owner))
            slot = swaps[rows, pick].astype(np.int64)
            swaps[rows, pick] = swaps[:, level]
        np.minimum.at(signature, owner * PLACES + slot, fraction | np.uint32(level << FRACTION_BITS))
        worst = signature.reshape(n_sets, PLACES).max(axis=1) >> FRACTION_BITS
        active = (worst > level)[owner]
        if swaps is None:
            state, owner, pick = state[active], owner[active], pick[active]
            swaps = np.tile(np.arange(PLACES, dtype=np.uint8), (len(owner), 1))
            swaps[np.arange(len(owner)), pick] = 0
        else:
            state, owner, swaps = state[active], owner[active], swaps[active]
    return signature.reshape(n_sets, PLACES)


def binned(elements: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Per set, a byte for the least element of each of ``BINS`` parts of the hash range; 0 if none."""
    n_sets = len(place) - 1
    least = np.full(n_sets * BINS, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n_sets), np.diff(place))
    draw = mix(elements ^ np.uint64(0x6C62272E07BB0142))
    part = (draw >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    np.minimum.at(least, owner * BINS + part, draw)
    value = (least & np.uint64(0xFFFF)) % np.uint64(255) + np.uint64(1)
    value[least == np.iinfo(np.uint64).max] = 0
    return value.astype(np.uint8).reshape(n_sets, BINS)


def near_enough(fine: np.ndarray, n: np.ndarray, i: int, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of sets ``j`` the sketch of set ``i`` does not rule out.

    Occupied bins are a sample, without replacement, of the union of two sets; at the threshold the
    share of equal bins deviates from it by the error of such a sample.
    """
    mine, theirs = fine[i], fine[j]
    used = ((mine != 0) | (theirs != 0)).sum(axis=1)
    equal = ((mine == theirs) & (mine != 0)).sum(axis=1)
    union = np.maximum((n[i] + n[j]) / (1 + threshold), 2.0)
    rest = np.maximum(union - used, 0.0) / (union - 1)
    error = np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1) * rest)
    return equal >= (threshold - DEVIATIONS * error - 0.02) * used


def distinct_sets(texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one text after another."""
    texts.data = LOWER[texts.data]
    words = split(texts, WHITE)
    elements, place = shingles(word_codes(texts.data, words), words.first, size)
    owner = np.repeat(np.arange(len(place) - 1), np.diff(place))
    order = np.lexsort((elements, owner))
    elements, owner = elements[order], owner[order]
    new = np.ones(len(elements), bool)
    new[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
    elements, owner = elements[new], owner[new]
    return elements, np.searchsorted(owner, np.arange(len(place)))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``_id``, set size, two fingerprints of the set, band keys, one byte of every place, the finer sketch."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = keyed(
        rows, "_id", "n_shingles long, f1 long, f2 long, bands array<long>, lanes binary, fine binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                elements, place = distinct_sets(texts, size)
                n = np.diff(place)
                prints = []
                for seed in (1, 2):
                    total = np.zeros(len(elements) + 1, np.uint64)
                    np.cumsum(mix(elements ^ mix(np.array([seed]))), out=total[1:])
                    prints.append(mix(total[place[1:]] - total[place[:-1]] + n.astype(np.uint64)))
                signature = super_minhash(elements, place)
                groups = signature.reshape(len(n), -1, BAND).astype(np.uint64)
                key = np.broadcast_to(np.arange(groups.shape[1], dtype=np.uint64), groups.shape[:2])
                for k in range(BAND):
                    key = mix(key + groups[:, :, k])
                lanes = (mix(signature) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.low, len(n)),
                        pa.array(n),
                        pa.array(signed(prints[0])),
                        pa.array(signed(prints[1])),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, key.size + 1, key.shape[1]), pa.int32()),
                            pa.array(signed(key.ravel())),
                        ),
                        pa.array([row.tobytes() for row in lanes], pa.binary()),
                        pa.array([row.tobytes() for row in binned(elements, place)], pa.binary()),
                    ],
                    schema.names,
                )

    return rows.mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs ``a``, ``b`` whose full shingle sets reach the threshold."""
    pairs = materialised(pairs)
    left = texts.select(F.col("_id").alias("a"), F.col("_text").alias("ta"))
    right = texts.select(F.col("_id").alias("b"), F.col("_text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                sets = []
                for k in (2, 3):
                    found = []
                    for t in slices(part.column(k)):
                        elements, place = distinct_sets(t, size)
                        found += [elements[i:j] for i, j in zip(place[:-1], place[1:], strict=True)]
                    sets.append(found)
                for i, (x, y) in enumerate(zip(*sets, strict=True)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[low + i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, both.select("a", "b").schema)


def residual_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs of one band (``key``) in different components whose estimate does not rule them out.

    Members of a band are dealt into blocks; two blocks meet in one task, which holds no more than
    these, and only the pairs that pass leave it.
    """
    sizes = members.groupBy("key").agg(
        F.count("*").alias("members"), F.min("component").alias("c1"), F.max("component").alias("c2")
    )
    blocks = F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")
    mixed = materialised(sizes.where("c1 <> c2").select("key", blocks))
    members = members.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # bands of one block share tasks, some thousand rows in each
    shares = F.lit(max(1, mixed.where("blocks = 1").count() * 8 // GROUP_ROWS))
    group = F.when(F.col("blocks") == 1, F.pmod("key", shares)).otherwise(F.col("key"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = members.withColumn("other", other).select(
        group.alias("share"), "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        "block", "id", "component", "n_shingles", "bands", "fine",
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable")
        fine = np.frombuffer(b"".join(group["fine"]), np.uint8).reshape(-1, BINS)
        ids, parts, key = (group[c].to_numpy() for c in ("id", "component", "key"))
        n, block = group["n_shingles"].to_numpy(), group["block"].to_numpy()
        bands = np.stack(group["bands"].to_numpy())
        x, y = int(group["x"].iat[0]), int(group["y"].iat[0])
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        found = [np.zeros((0, 2), ids.dtype)]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows = np.arange(low, high)
            second = rows[block[low:high] == y]
            for i in rows[block[low:high] == x].tolist():
                j = second[(parts[second] != parts[i]) & ((x != y) | (ids[second] > ids[i]))]
                j = j[np.minimum(n[j], n[i]) >= threshold * np.maximum(n[j], n[i])]
                if len(j):
                    j = j[near_enough(fine, n, i, j, threshold)]
                    # a pair counts in the first band it shares
                    j = j[bands[i, (bands[j] == bands[i]).argmax(axis=1)] == key[i]]
                    found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    kind = members.schema["id"].dataType.simpleString()
    return met.groupBy("share", "x", "y").applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    threshold: float = 0.75,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable by links), ``kept``.

    Words are runs of anything but ASCII white space, A-Z in lower case. A text shorter than a
    shingle is one shingle; an empty or null text has none and links with nothing. Two rows of one
    id are one node (their sizes are reported row by row). A null id links with nothing and has a
    null component; it is kept. Extra columns are ignored; an empty table gives no rows.
    """
    rows = materialised(sketches(docs, id_col, text_col, size))
    real = rows.where("n_shingles > 0 AND _id IS NOT NULL")
    same = real.groupBy("n_shingles", "f1", "f2").agg(F.min("_id").alias("first"))
    same = materialised(same)
    heads = materialised(real.join(same, ["n_shingles", "f1", "f2"]).select(
        "_id", "first", "n_shingles", "bands", "lanes", "fine"
    ))
    copies = heads.where("_id <> first").select(F.col("_id").alias("a"), F.col("first").alias("b"))
    unique = heads.where("_id = first").dropDuplicates(["_id", "lanes"])
    banded = unique.select(F.col("_id").alias("id"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most")
    shared = materialised(shared.select("key", "least"))
    member = materialised(banded.join(shared, "key"))
    involved = member.select(F.col("id").alias("_id")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = materialised(texts.join(involved, "_id", "left_semi"))
    stars = member.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    bounds = unique.select("_id", "n_shingles", "lanes")
    stars = plausible(stars, bounds, threshold)
    links = materialised(copies.union(verified(stars, texts, size, threshold)))
    labels = components(links)
    joined = (
        member.join(labels, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .select("key", "id", "component")
    )
    details = joined.join(unique.select(F.col("_id").alias("id"), "n_shingles", "bands", "fine"), "id")
    rest = residual_pairs(details, threshold)
    more = materialised(verified(rest, texts, size, threshold))
    if more.limit(1).count():
        links = links.union(more)
        labels = components(links)
    out = rows.select("_id", "n_shingles").join(labels.withColumnRenamed("id", "_id"), "_id", "left")
    component = F.coalesce("component", "_id")
    return out.select(
        F.col("_id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"),
    )


def plausible(pairs: DataFrame, bounds: DataFrame, threshold: float) -> DataFrame:
    """Pairs that sizes and signatures do not rule out."""
    left = bounds.select(F.col("_id").alias("a"), F.col("n_shingles").alias("na"), F.col("lanes").alias("la"))
    right = bounds.select(F.col("_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("lanes").alias("lb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, PLACES)
            y = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, PLACES)
            keep = (x == y).mean(axis=1) >= threshold - SLACK
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    both = both.select("a", "b", "la", "lb")
    return both.mapInArrow(run, both.select("a", "b").schema)
