"""Benchmark decontamination: SimHash windows of the size of each item.

Every window of a document with as many words as an item gets a 64-bit SimHash of its shingles: a
bit is the sign of the sum of its shingles' signs. An item and a window whose weighted shingles
reach the similarity differ in few bits, so fingerprints within ``radius`` are the candidates. The
64 bits are cut into blocks; two fingerprints within the radius have a block within the share
``radius // blocks`` of it, so looking up, for each block, the items within that share finds every
one (multi-index hashing). Bags in which a shingle repeats can be similar at a wider angle, so windows
and items that hold one have a radius of their own, from the sizes and norms of both bags (``wider``),
up to every fingerprint. Candidates are verified on exact weighted shingles: the sum of the
smaller counts over the sum of the larger.

A window that shares no shingle with an item cannot be similar to it, so windows are formed only
where a document shares enough shingles with an item of that size. That is a bound, not a heuristic:
of the window's and the item's shingles at least ``2 s / (1 + s)`` on average must be common.

The items are a query set: their shingles are held by every task, in blocks of items, and all
documents pass by each block once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import LOWER, NOT_ALNUM, keyed, shingles, slices, split, word_codes

SHINGLE = 5
SIMILARITY = 0.75
RADIUS = 26
BLOCKS = 8
ITEM_BLOCK = 20_000
WINDOW_BLOCK = 4096

POPULATION = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def signs(codes: np.ndarray) -> np.ndarray:
    """The 64 signs of each shingle, +1 or -1."""
    bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def simhash(totals: np.ndarray) -> np.ndarray:
    """Fingerprints, as eight bytes, of rows of 64 sums of signs; a zero sum counts as positive."""
    return np.packbits(totals >= 0, axis=1)


class Index:
    """Items of one size, found by fingerprint; ``norms`` are the squared norms of their bags."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, norms: np.ndarray | None = None):
        self.prints, self.radius, self.norms = prints, radius, norms
        share = radius // BLOCKS
        every = np.arange(256, dtype=np.uint8)
        #: near[block, value, item]: the item's block is within the share of the value
        self.near = np.stack(
            [POPULATION[every[:, None] ^ prints[None, :, k]] <= share for k in range(BLOCKS)]
        )

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) pairs within the radius."""
        found = np.zeros((len(prints), len(self.prints)), bool)
        for k in range(BLOCKS):
            found |= self.near[k][prints[:, k]]
        row, item = np.nonzero(found)
        close = POPULATION[prints[row] ^ self.prints[item]].sum(axis=1, dtype=np.int32) <= self.radius
        return row[close], item[close]

    def repeating(self, prints: np.ndarray, norms: np.ndarray, items: np.ndarray, common: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) pairs within the radius of their norms, of all rows and the given items."""
        rows, chosen = [], []
        step = max(1, (1 << 20) // max(len(items), 1))
        for low in range(0, len(prints), step):
            part = slice(low, low + step)
            apart = np.zeros((len(prints[part]), len(items)), np.int32)
            for k in range(BLOCKS):
                apart += POPULATION[prints[part, k][:, None] ^ self.prints[items, k][None, :]]
            r, i = np.nonzero(apart <= np.maximum(wider(common, norms[part], self.norms[items]), self.radius))
            rows.append(r + low)
            chosen.append(items[i])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *chosen])


def wider(common: float, norms: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Radius for bags that share ``common`` shingles, counted with repeats, by their squared norms.

    Their inner product is ``common`` at least, which bounds the angle; the share of differing bits
    is the angle over pi on average, and five deviations are added.
    """
    cosine = np.minimum(common / np.sqrt(norms[:, None] * others[None, :]), 1.0)
    share = np.arccos(cosine) / np.pi
    return np.ceil(64 * share + 5 * np.sqrt(64 * share * (1 - share)))


def squared(bag: np.ndarray) -> int:
    """Squared norm of a bag: the sum of its shingles' squared counts."""
    return int((np.unique(bag, return_counts=True)[1] ** 2).sum())


def repeats_within(bag: np.ndarray, starts: np.ndarray, per: int) -> np.ndarray:
    """Whether each window of ``per`` shingles holds one of them twice."""
    order = np.argsort(bag, kind="stable")
    following = np.full(len(bag), len(bag) + per)
    same = bag[order[1:]] == bag[order[:-1]]
    following[order[:-1][same]] = order[1:][same]
    soonest = np.minimum.accumulate(following[::-1])[::-1]
    return soonest[starts] < starts + per


def weighted(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted similarity of two bags of shingles."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    return both / (len(a) + len(b) - both) if both else 0.0


def tokens(texts):
    texts.data = LOWER[texts.data]
    words = split(texts, NOT_ALNUM)
    return words, word_codes(texts.data, words)


class Items:
    """Shingles and fingerprints of a block of items, by number of words."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, self.bags, self.words = [], [], []
        column = pa.array(texts, pa.string())
        for part in slices(column):
            words, codes = tokens(part)
            bags, place = shingles(codes, words.first, SHINGLE)
            for k, n in enumerate(words.counts.tolist()):
                if n:  # an item without words matches nothing
                    self.ids.append(ids[part.low + k])
                    self.bags.append(bags[place[k] : place[k + 1]])
                    self.words.append(n)
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.bags]))
        self.sizes = {}
        for n in sorted(set(self.words)):
            chosen = [i for i, w in enumerate(self.words) if w == n]
            prints = np.concatenate([simhash(signs(self.bags[i]).sum(axis=0)[None, :]) for i in chosen])
            shared = np.unique(np.concatenate([self.bags[i] for i in chosen]))
            norms = np.array([squared(self.bags[i]) for i in chosen], float)
            self.sizes[n] = (chosen, Index(prints, norms=norms), shared)

    def matches(self, codes: np.ndarray, similarity: float) -> dict[int, tuple[float, int, int]]:
        """Item index to (similarity, first word, words) of its best window in one text, earliest on ties."""
        best: dict[int, tuple[float, int, int]] = {}
        total = len(codes)
        for n, (chosen, index, shared) in self.sizes.items():
            size = min(n, total)
            width = min(SHINGLE, n)
            bag, _ = shingles(codes, np.array([0, total]), width)
            per = max(size - width + 1, 1)
            hit = np.isin(bag, shared)
            if not hit.any():
                continue
            running = np.concatenate([[0], np.cumsum(hit)])
            starts = np.arange(len(bag) - per + 1)
            items_per = n - width + 1
            common = similarity * (per + items_per) / (1 + similarity)
            need = max(1, math.ceil(common - 1e-9))
            starts = starts[running[starts + per] - running[starts] >= need]
            twice = repeats_within(bag, starts, per)
            many = np.flatnonzero(index.norms > items_per)  # items with a repeated shingle
            for low in range(0, len(starts), WINDOW_BLOCK):
                part = starts[low : low + WINDOW_BLOCK]
                for a, b in runs_of(part, per):
                    sums = np.zeros((part[b - 1] + per - part[a] + 1, 64), np.int32)
                    np.cumsum(signs(bag[part[a] : part[b - 1] + per]), axis=0, out=sums[1:])
                    local = part[a:b] - part[a]
                    prints = simhash(sums[local + per] - sums[local])
                    row, item = index.candidates(prints)
                    again = twice[low + a : low + b]
                    if len(many) or again.any():
                        norms = np.full(len(local), float(per))
                        for k in np.flatnonzero(again).tolist():
                            norms[k] = squared(bag[part[a + k] : part[a + k] + per])
                        pairs = [(row, item)]
                        if len(many):
                            pairs.append(index.repeating(prints, norms, many, common))
                        if again.any():
                            at = np.flatnonzero(again)
                            r, i = index.repeating(prints[at], norms[at], np.arange(len(chosen)), common)
                            pairs.append((at[r], i))
                        both = np.unique(np.concatenate([r * len(chosen) + i for r, i in pairs]))
                        row, item = both // len(chosen), both % len(chosen)
                    for r, i in zip(row.tolist(), item.tolist(), strict=True):
                        at = int(part[a + r])
                        value = weighted(bag[at : at + per], self.bags[chosen[i]])
                        if value >= similarity - 1e-12:
                            have = best.get(chosen[i])
                            if have is None or value > have[0]:
                                best[chosen[i]] = (value, at, size)
        return best


def runs_of(starts: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """Index ranges of starts that lie within ``gap`` of the one before."""
    cut = np.flatnonzero(np.diff(starts) > gap) + 1
    edges = np.concatenate([[0], cut, [len(starts)]]).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Matches: ``id_col``, ``item_col``, ``first_word``, ``n_words``, ``similarity``.

    One row per document row and item with a window of the item's number of words (the whole
    document where it has fewer) whose weighted five-word shingles reach ``similarity``; the best
    window, the earliest on ties. Words are runs of letters, digits and non-ASCII, A-Z in lower
    case. A text of fewer words than a shingle is one shingle. Null and empty texts and items match
    nothing; a null id is carried; documents and items that repeat are matched row by row; extra
    columns are ignored. Without documents or items there are no rows.
    """
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    part = F.pmod(F.xxhash64(item_col, item_text_col), F.lit(blocks))
    passes = [one_pass(docs, items.where(part == b), similarity, id_col, text_col, item_col, item_text_col) for b in range(blocks)]
    out = passes[0]
    for more in passes[1:]:
        out = out.union(more)
    return out


def one_pass(docs, items, similarity, id_col, text_col, item_col, item_text_col) -> DataFrame:
    """All documents against one block of items."""
    rows = items.select(item_col, item_text_col).collect()
    shared = docs.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    item_type = items.schema[item_col].dataType.simpleString()
    schema = keyed(source, "_id", f"item {item_type}, first_word long, n_words long, similarity double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        items = Items(*shared.value)
        widths = sorted({min(SHINGLE, n) for n in items.words})
        item_kind = to_arrow_type(schema["item"].dataType)
        for batch in batches:
            found = []
            for texts in slices(batch.column(1)):
                words, codes = tokens(texts)
                touched: set[int] = set()
                for width in widths:
                    bag, place = shingles(codes, words.first, width)
                    at = np.minimum(np.searchsorted(items.known, bag), len(items.known) - 1)
                    hits = np.flatnonzero(items.known[at] == bag)
                    touched.update((np.searchsorted(place, hits, "right") - 1).tolist())
                for k in sorted(touched):
                    own = codes[words.first[k] : words.first[k + 1]]
                    for item, (value, first, n) in sorted(items.matches(own, similarity).items()):
                        found.append((texts.low + k, items.ids[item], first, n, value))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([f[1] for f in found], item_kind),
                    pa.array([f[2] for f in found], pa.int64()),
                    pa.array([f[3] for f in found], pa.int64()),
                    pa.array([f[4] for f in found], pa.float64()),
                ],
                schema.names,
            )

    return source.mapInArrow(run, schema).withColumnsRenamed({"_id": id_col, "item": item_col})
