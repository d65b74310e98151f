"""Array kernels over UTF-8 text: slices of Arrow columns, words, and fingerprints of spans.

A fingerprint of a span is the polynomial ``sum(value[i] * B**(i - start))``, taken from one running
sum and mixed at the end, so any span of a buffer costs a constant number of operations. Where
results depend on equality, the polynomials are taken modulo the prime 2**31 - 1, two of them to a
fingerprint (``Prints``), and two fingerprints stand for long spans. Modulo 2**64 (``Spans``) there
are long words that agree at every base: such values only deal rows and rank them. Words are no
polynomials: their bytes are mixed eight at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 1 << 19
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of bytes, true inside the closed ranges."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


WHITE = table((0x20, 0x20), (0x09, 0x0D))
NEWLINE = table((0x0A, 0x0A))
#: What separates words of letters, digits and non-ASCII once A-Z is lower case.
NOT_ALNUM = table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int, inverse: bool = False) -> np.ndarray:
    """``B**0 .. B**(n-1)`` of a base, or of its inverse, modulo 2**64."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(BASES[which], -1, 1 << 64) if inverse else BASES[which]
        have = np.full(1 << max(n - 1, 1 << 14).bit_length(), base, dtype=np.uint64)
        have[0] = 1
        _powers[which, inverse] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


class Spans:
    """Fingerprints of spans of one sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        self.which = which
        self.running = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(n, which), out=self.running[1:], dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(len(self.running), self.which, True)
        return mix((self.running[end] - self.running[start]) * inverse[start])


PRIME = np.uint64((1 << 31) - 1)
PRIME_BASES = (0x2545F491, 0x5851F42D, 0x369DEA0F, 0x4F1BBCDC)
_prime_powers: dict[tuple[int, bool], np.ndarray] = {}


def modulo(x: np.ndarray) -> np.ndarray:
    """Values below 2**62 modulo the prime, the prime itself for some multiples of it."""
    x = (x & PRIME) + (x >> np.uint64(31))
    return (x & PRIME) + (x >> np.uint64(31))


def prime_powers(n: int, lane: int, inverse: bool = False) -> np.ndarray:
    """``B**0 .. B**(n-1)`` of a lane's base, or of its inverse, modulo the prime."""
    base = PRIME_BASES[lane] if not inverse else pow(PRIME_BASES[lane], -1, int(PRIME))
    have = _prime_powers.get((lane, inverse), np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, modulo(have * np.uint64(pow(base, len(have), int(PRIME))))])
    _prime_powers[lane, inverse] = have
    return have[:n]


class Prints:
    """Fingerprints of spans of one sequence of 64-bit values: two polynomials modulo a prime.

    ``which`` (0 or 1) names the pair of bases; each polynomial takes another half of the values.
    """

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        self.lanes = (2 * which, 2 * which + 1)
        self.running = []
        for lane, half in zip(self.lanes, (values & PRIME, values >> np.uint64(33)), strict=True):
            running = np.zeros(n + 1, np.uint64)
            half *= prime_powers(n, lane)
            high = half >> np.uint64(31)
            half &= PRIME
            half += high  # below 2**32: sums of 2**30 of them stay below 2**62
            np.cumsum(half, out=running[1:])
            self.running.append(running)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        for lane, running in zip(self.lanes, self.running, strict=True):
            inverse = prime_powers(len(running), lane, True)
            value = modulo(modulo(running[end] - running[start]) * inverse[start])
            out = (out << np.uint64(31)) | np.where(value == PRIME, np.uint64(0), value)
        return mix(out)


class BytePrints(Prints):
    """The same of bytes: both polynomials take the byte plus one."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        self.lanes = (2 * which, 2 * which + 1)
        self.running = []
        values = data.astype(np.uint64) + np.uint64(1)
        for lane in self.lanes:
            running = np.zeros(n + 1, np.uint64)
            terms = values * prime_powers(n, lane)  # below 2**39: sums of 2**23 of them stay below 2**62
            if n > 1 << 23:
                terms = (terms & PRIME) + (terms >> np.uint64(31))
            np.cumsum(terms, out=running[1:])
            self.running.append(running)


@dataclass
class Texts:
    """Consecutive rows of a batch: their bytes, and where each row's bytes begin and end."""

    low: int
    high: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column into runs of whole rows of about ``limit`` bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    n = len(column)
    if n == 0:
        return
    _, ends, body = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, n)
        yield Texts(low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


@dataclass
class Words:
    """Word spans in the bytes of some texts; words of text i are ``first[i] .. first[i+1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split(texts: Texts, separator: np.ndarray) -> Words:
    """Maximal runs of bytes that do not separate, cut at the ends of texts."""
    n = len(texts.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(texts.offsets), np.int64))
    inside = ~separator[texts.data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[texts.offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    start = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return Words(start, end, np.searchsorted(start, texts.offsets))


EIGHT = 8
TAIL = np.array([(1 << (8 * k)) - 1 for k in range(EIGHT + 1)], dtype=np.uint64)


def word_codes(data: np.ndarray, words: Words, which: int = 0) -> np.ndarray:
    """A fingerprint of each word: its bytes eight at a time, each eight mixed with its place before
    they are summed, so that no two words of up to eight bytes and one length share one.
    """
    size = words.end - words.start
    padded = np.zeros(len(data) + EIGHT, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    salt = mix(np.array([which + 1], np.uint64))
    out = mix((eights[words.start] & TAIL[np.minimum(size, EIGHT)]) ^ salt)
    long = np.flatnonzero(size > EIGHT)
    if len(long):
        more = (size[long] - 1) // EIGHT
        ends = np.cumsum(more)
        owner = np.repeat(long, more)
        place = np.arange(ends[-1]) - np.repeat(ends - more, more) + 1
        at = words.start[owner] + EIGHT * place
        value = eights[at] & TAIL[np.minimum(words.end[owner] - at, EIGHT)]
        part = mix(mix(value ^ salt) + place.astype(np.uint64) * np.uint64(BASES[0]))
        out[long] += np.add.reduceat(part, ends - more)
    return mix(out + size.astype(np.uint64) * np.uint64(BASES[1]))


def shingles(codes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``size`` consecutive words of one text, and each text's place among them.

    A text of fewer words has one: its whole sequence. A text without words has none.
    """
    counts = np.diff(first)
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    place = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(number, out=place[1:])
    text = np.repeat(np.arange(len(counts)), number)
    start = first[:-1][text] + (np.arange(place[-1]) - place[:-1][text])
    length = np.minimum(counts, size)[text]
    out = Prints(codes).of(start, start + length)
    return mix(out + length.astype(np.uint64)), place


def signed(values: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def keyed(df: DataFrame, column: str, rest: str) -> T.StructType:
    """Schema of rows that carry ``column`` as ``_id`` beside the columns named in ``rest``."""
    own = T.StructField("_id", df.schema[column].dataType)
    return T.StructType([own, *T.StructType.fromDDL(rest).fields])
