"""Packing: documents into fixed windows of tokens, cuts chosen by dynamic programming.

Rows keep their order. The cut points are ends of documents and of sentences (and inside a sentence
only where none ends for long, at words). Over the cut points of a run of rows

    cost(j) = min over i, position(j) - position(i) <= width, of
              cost(i) + padding(position(j) - position(i)) + penalty(j)

where padding is what the window lacks, none at a power of two, and the penalty is zero at the end
of a document. ``cost(i) + position(i)`` does not depend on j, so a monotone queue gives each
minimum in constant time; windows of a power of two are looked up. Every task packs the rows it
scans, holding about ``BLOCK`` tokens: nothing is shuffled, and a lost task is packed again alike.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tickloom.llm.text import NEWLINE, WHITE, keyed, slices, table

BLOCK = 1 << 18
SLICE = 1 << 21
CACHE = 1 << 20
END_ID = 1
SENTENCE_PENALTY = 16
INSIDE_PENALTY = 64
WINDOW_COST = 8
#: Stretches without a cheap cut of more than ``LONG`` tokens can be cut at a word about every ``STEP``.
LONG, STEP = 128, 64

STOPS = table((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))
CLOSERS = np.isin(np.arange(256), list(b"\"')]}>"))
#: Terminators that need no space after them, and closers and spaces of several bytes.
WIDE_STOPS = [c.encode() for c in "。！？；।؟۔"]
WIDE_CLOSERS = [c.encode() for c in "»”’"]
WIDE_SPACES = [c.encode() for c in "\u0085\u00a0\u2028\u2029\u202f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))]


def follows(data: np.ndarray, at: np.ndarray, wanted: list[bytes]) -> np.ndarray:
    """Length of the wanted character that begins at each place, else 0; ``data`` ends in padding."""
    out = np.zeros(len(at), np.int64)
    lead = np.zeros(256, bool)
    lead[[c[0] for c in wanted]] = True
    some = np.flatnonzero(lead[data[at]])
    for c in wanted if len(some) else []:
        hit = np.ones(len(some), bool)
        for k, byte in enumerate(c):
            hit &= data[at[some] + k] == byte
        out[some[hit]] = len(c)
    return out


def sentence_ends(data: np.ndarray) -> np.ndarray:
    """Ascending byte positions before the white space of a line end, after a stop (and up to eight closers) that white
    space follows, and after a terminator of a script that sets no space."""
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    end = np.flatnonzero(STOPS[data]) + 1
    going = np.arange(len(end))
    for _ in range(8):
        at = end[going]
        size = np.where(CLOSERS[padded[at]], 1, follows(padded, at, WIDE_CLOSERS))
        going = going[size > 0]
        if not len(going):
            break
        end[going] += size[size > 0]
    end = end[WHITE[padded[end]] | (follows(padded, end, WIDE_SPACES) > 0)]
    wide = np.flatnonzero(data >= 0xC0)
    size = follows(padded, wide, WIDE_STOPS)
    line = np.flatnonzero(NEWLINE[data])
    going = np.arange(len(line))
    for _ in range(8):
        at = line[going]
        going = going[(at > 0) & WHITE[data[at - 1]]] if len(at) else going
        line[going] -= 1
    return ascending(np.concatenate([end, (wide + size)[size > 0], line]))


def ascending(values: np.ndarray) -> np.ndarray:
    """The different values in order."""
    values = np.sort(values, kind="stable")
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class Encoder:
    """Token ids of texts, equal to encoding each text whole.

    Byte-level pre-tokens never cross from a non-space character over one space to a non-space
    character, so such words are encoded once, many in a row, and remembered; a token that begins
    with the space begins a word. A text with any other run of white space is encoded whole.
    Sentence ends are found in the bytes of all texts alike and placed by the bytes each token stands for.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        space = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0][0]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[0] == space]] = True
        self.bytes = np.zeros(len(self.opens), np.int64)  # a character of a byte-level token is a byte
        self.bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.place = np.zeros(1, np.int64)

    def add(self, words: list[str]) -> None:
        """Learn words; those that are empty or have white space at an end are marked odd."""
        clean = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        rows = [" " + " ".join(clean[i : i + 256]) for i in range(0, len(clean), 256)]
        encoded = self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in encoded)])
        starts = np.flatnonzero(self.opens[flat])
        assert len(starts) == len(clean)
        at = len(self.place) - 1
        self.known.update((w, -1) for w in words if not w or w[0].isspace() or w[-1].isspace())
        self.known.update(zip(clean, range(at, at + len(clean)), strict=True))
        self.place = np.concatenate([self.place[:-1], self.place[-1] + starts, [self.place[-1] + len(flat)]])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in order, each text's number of ids, and the positions where a sentence ends."""
        if len(self.known) > CACHE:
            self.clear()
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts = texts.fill_null("")
        parts = pc.split_pattern(texts, " ")
        counts = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        # only the different words of a slice are looked up one by one
        coded = parts.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        words = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))
        words = pc.binary_join(words, " ")[0].as_py().split(" ") if len(which) else []  # no word holds a space
        each = np.fromiter(map(self.known.get, words, repeat(-2)), np.int64, len(words))
        unseen = np.flatnonzero(each == -2).tolist()
        if unseen:
            self.add([words[i] for i in unseen])
            each[unseen] = [self.known[words[i]] for i in unseen]
        every = each[which] if len(which) else np.zeros(0, np.int64)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(counts, out=at[1:])
        odd = ascending(np.repeat(np.arange(len(texts)), counts)[every < 0]).tolist()
        # a text's first word has no space before it; odd texts are one item
        first = [words[i] for i in which[at[:-1]].tolist()]
        for i in odd:
            first[i] = texts[i].as_py()
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(first, add_special_tokens=False)]
        every = np.maximum(every, 0)
        size = np.diff(self.place)[every] if len(self.flat) else np.zeros(len(every), np.int64)
        for i in odd:
            size[at[i] : at[i + 1]] = 0
        size[at[:-1]] = 0
        if len(self.flat):
            gaps = np.repeat(self.place[every] - (np.cumsum(size) - size), size)
            ids = self.flat[gaps + np.arange(len(gaps))]
        else:
            ids = np.zeros(0, np.uint32)
        before = np.concatenate([[0], np.cumsum(size)])[at[:-1]]
        own = np.fromiter(map(len, whole), np.int64, len(whole))
        ids = np.insert(ids, np.repeat(before, own), np.fromiter((i for w in whole for i in w), np.uint32))
        size[at[:-1]] = own
        ends = np.cumsum(size)
        totals = np.diff(np.concatenate([[0], ends])[at])
        return ids, totals, self.sentences(texts, ids)

    def sentences(self, texts: pa.Array, ids: np.ndarray) -> np.ndarray:
        """How many of all ids lie before each sentence end of the texts."""
        data = next((part.data for part in slices(texts, 1 << 62)), np.zeros(0, np.uint8))
        size = self.bytes[ids]
        stop = np.cumsum(size)
        if len(data) != (stop[-1] if len(stop) else 0):
            raise ValueError("the tokens do not stand for the bytes of the texts")
        return ascending(np.searchsorted(stop - size, sentence_ends(data), "left"))


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ranges(sizes: np.ndarray) -> np.ndarray:
    """0 .. size-1 for each size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def choose(position: list[int], penalty: list[int], width: int) -> list[int]:
    """Indices of the chosen cuts, first and last included; neighbours are at most ``width`` apart."""
    places = np.asarray(position)
    even: list[list[int]] = [[] for _ in position]  # cuts a power of two before each cut
    for k in range(8, width.bit_length()):
        if 1 << k < width:
            at = np.searchsorted(places, places - (1 << k))
            for j in np.flatnonzero(places[at] == places - (1 << k)).tolist():
                even[j].append(int(at[j]))
    cost, back = [0] * len(position), [0] * len(position)
    base = [0] * len(position)
    base[0] = position[0]
    queue = deque([0])
    for j in range(1, len(position)):
        here = position[j]
        while position[queue[0]] < here - width:
            queue.popleft()
        i = queue[0]
        best = base[i] + width - here
        for k in even[j]:
            if cost[k] < best:
                best, i = cost[k], k
        cost[j], back[j] = best + penalty[j] + WINDOW_COST, i
        base[j] = cost[j] + here
        while queue and base[queue[-1]] >= base[j]:
            queue.pop()
        queue.append(j)
    chosen = [len(position) - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


def cut_points(
    ends: np.ndarray, sentences: np.ndarray, width: int, words: np.ndarray | None = None
) -> tuple[list[int], list[int]]:
    """Positions and penalties of all cut points from 0 to the last end.

    Long stretches between ends and sentence ends get dear cuts, at the last of ``words`` (ascending
    positions where a word begins) before each step, or at the step where no word begins.
    """
    position = ascending(np.concatenate([[0], ends, sentences]))
    step = min(STEP, width)
    gap = np.diff(position)
    extra = np.where(gap > min(LONG, width), np.maximum(gap - 1, 0) // step, 0)
    inside = np.repeat(position[:-1], extra) + (ranges(extra) + 1) * step
    if words is not None and len(words) and len(inside) and 2 * step <= width:
        word = words[np.maximum(np.searchsorted(words, inside, "right") - 1, 0)]
        inside = np.where((word > inside - step) & (word <= inside), word, inside)
    everything = ascending(np.concatenate([position, inside]))
    penalty = np.full(len(everything), INSIDE_PENALTY)
    penalty[np.searchsorted(everything, position)] = SENTENCE_PENALTY
    penalty[np.searchsorted(everything, ends)] = 0
    return everything.tolist(), penalty.tolist()


class Packer:
    """Packs a stream of documents; ``emit`` gets (document, start, ids, size, window, offset)."""

    def __init__(self, width: int, opens: np.ndarray | None = None):
        self.width = width
        self.opens = opens  # by id: whether a word begins with it
        self.window = 0
        self.ids = np.zeros(0, np.uint32)
        self.ends: list[int] = []
        self.sentences: list[np.ndarray] = []
        self.documents: list[tuple[object, int, int]] = []  # id, begin here (maybe before 0), size
        self.held: list[np.ndarray] = []
        self.size = 0

    def push(self, ids: np.ndarray, documents: list[tuple[object, int]], sentences: np.ndarray) -> None:
        self.sentences.append(sentences + self.size)
        self.held.append(ids)
        at = self.size
        for name, n in documents:
            self.documents.append((name, at, n))
            at += n
        self.size += len(ids)

    def pack(self, last: bool) -> Iterator[tuple]:
        """Pieces of the windows that are settled: all of them at the end, else all but the last."""
        if not self.size:
            return
        ids = np.concatenate(self.held)
        ends = np.array([begin + n for _, begin, n in self.documents])
        sentences = np.concatenate(self.sentences)
        words = None if self.opens is None else np.flatnonzero(self.opens[ids])
        position, penalty = cut_points(ends, sentences, self.width, words)
        chosen = [position[i] for i in choose(position, penalty, self.width)]
        settled = chosen if last else chosen[:-1]
        doc = 0
        for low, high in zip(settled[:-1], settled[1:], strict=True):
            at = low
            while at < high:
                name, begin, n = self.documents[doc]
                stop = min(high, begin + n)
                yield name, at - begin, ids[at:stop], n, self.window, at - low
                at = stop
                if stop == begin + n:
                    doc += 1
            self.window += 1
        done = settled[-1]
        self.held, self.size = [ids[done:]], self.size - done
        self.sentences = [sentences[sentences > done] - done]
        self.documents = [(name, begin - done, n) for name, begin, n in self.documents[doc:]]


PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, tokenizer: str, width: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack all documents into windows of at most ``width`` tokens; one row per piece.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers; the last id of every
    document is 1. A window's pieces lie from offset 0 without gaps, in row order. Null text counts
    as empty (its end id alone); ids that are null or repeated are carried as they are, one document
    per row; extra columns are ignored; an empty table gives no rows. ``tokenizer`` is the path of a
    tokenizer file present on every executor.
    """
    source = docs.select(id_col, text_col)
    schema = keyed(docs, id_col, PIECES)
    kind = source.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        base = TaskContext.get().partitionId() << 33
        encoder = encoder_for(tokenizer)
        packer = Packer(width, encoder.opens)
        id_type = to_arrow_type(kind)

        def rows(last: bool) -> pa.RecordBatch:
            found = list(packer.pack(last))
            column = lambda k: [f[k] for f in found]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(column(0), id_type),
                    pa.array(column(1), pa.int64()),
                    pa.array([len(x) for x in column(2)], pa.int64()),
                    pa.array([x.tobytes() for x in column(2)], pa.binary()),
                    pa.array(column(3), pa.int64()),
                    pa.array([base + w for w in column(4)], pa.int64()),
                    pa.array(column(5), pa.int64()),
                ],
                schema.names,
            )

        for batch in batches:
            for texts in slices(batch.column(1), SLICE):
                part = batch.column(1).slice(texts.low, texts.high - texts.low)
                ids, sizes, sentences = encoder.encode(part)
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, END_ID)
                before = np.searchsorted(ends, sentences, "left")
                names = batch.column(0).slice(texts.low, len(sizes)).to_pylist()
                packer.push(ids, list(zip(names, (sizes + 1).tolist(), strict=True)), sentences + before)
                if packer.size > BLOCK:
                    yield rows(False)
        yield rows(True)

    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
