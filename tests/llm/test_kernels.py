"""Array kernels against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import contamination, contextlm, minhash, packing, recompress, suffixes, text


def whole(texts):
    return next(iter(text.slices(pa.array(texts, pa.string()))))


def test_words_and_shingles_match_python():
    rows = ["a b  c", "", " x ", "d e f g h i", "é é z"]
    t = whole(rows)
    words = text.split(t, text.WHITE)
    plain = [r.encode().split() for r in rows]
    assert words.counts.tolist() == [len(p) for p in plain]
    assert [bytes(t.data[a:b]) for a, b in zip(words.start, words.end, strict=True)] == sum(plain, [])
    codes = text.word_codes(t.data, words)
    by_word = collections.defaultdict(set)
    for word, code in zip(sum(plain, []), codes.tolist(), strict=True):
        by_word[word].add(code)
    assert all(len(v) == 1 for v in by_word.values()) and len(set(codes.tolist())) == len(by_word)
    _, place = text.shingles(codes, words.first, 5)
    assert np.diff(place).tolist() == [1, 0, 1, 2, 1]


def test_word_codes_tell_lengths_places_and_zero_bytes_apart():
    words = ["a" * n for n in range(1, 40)] + ["a\0", "a\0\0", "\0", "a" * 8 + "\0", "a" * 16 + "\0"]
    words += ["abcdefgh" + "12345678", "12345678" + "abcdefgh", "x" * 24 + "y" * 8, "y" * 8 + "x" * 24]
    words += ["z" * k + "q" + "z" * (30 - k) for k in range(31)]
    for rows in (words, [" ".join(words)]):
        t = whole(rows)
        for which in (0, 1):
            codes = text.word_codes(t.data, text.split(t, text.WHITE), which)
            assert len(codes) == len(words) == len(set(codes.tolist()))
    alone = [text.word_codes(t.data, text.split(t, text.WHITE))[0] for t in map(whole, ([w] for w in words))]
    t = whole([" ".join(words)])
    assert alone == text.word_codes(t.data, text.split(t, text.WHITE)).tolist()


def test_slices_cut_between_rows():
    column = pa.array(["abc", None, "d" * 50, "", "e"])
    parts = list(text.slices(column, limit=10))
    assert [(p.low, p.high) for p in parts] == [(0, 2), (2, 3), (3, 5)]
    assert b"".join(bytes(p.data) for p in parts) == b"abc" + b"d" * 50 + b"e"


def plain_super_minhash(elements):
    """The signature by its definition: least (level + fraction) over elements, no early stop."""
    m = minhash.PLACES
    out = [2**32 - 1] * m
    mask = (1 << 64) - 1
    for e in elements:
        state = int(text.mix(np.array([e], np.uint64))[0])
        order = list(range(m))
        for level in range(m):
            step = (level + 1) * 0x9E3779B97F4A7C15 & mask
            draw = int(text.mix(np.array([(state + step) & mask], np.uint64))[0])
            k = level + ((draw & 0xFFFFFFFF) * (m - level) >> 32)
            order[level], order[k] = order[k], order[level]
            value = level << minhash.FRACTION_BITS | draw >> (64 - minhash.FRACTION_BITS)
            out[order[level]] = min(out[order[level]], value)
    return out


@pytest.mark.parametrize("size", [0, 1, 3, 40, 300])
def test_super_minhash_stops_early_with_the_same_result(size):
    rng = np.random.default_rng(size)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (size, 7)]
    place = np.array([0, size, size + 7])
    got = minhash.super_minhash(np.concatenate(sets), place)
    for k, s in enumerate(sets):
        assert got[k].tolist() == plain_super_minhash(s.tolist())


def test_super_minhash_estimates_the_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(40):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 50, 50))
        both = np.concatenate([common, a, common, b])
        s = minhash.super_minhash(both, np.array([0, 350, 700]))
        errors.append((s[0] == s[1]).mean() - 0.75)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def equal_windows_have_equal_anchors(rows, width, kernel, units):
    runs = kernel(whole(rows), width)
    anchors, seen = collections.defaultdict(set), collections.Counter()
    for t, key, low, high, anchor in zip(runs.text, runs.key, runs.low, runs.high, runs.anchor, strict=True):
        content = units(rows[t])
        for p in range(low, high + 1):
            seen[t, p] += 1
            anchors[tuple(content[p : p + width])].add((int(key), int(anchor - p)))
    assert set(seen.values()) <= {1}
    assert len(seen) == sum(max(0, len(units(r)) - width + 1) for r in rows)
    assert all(len(v) == 1 for v in anchors.values())


@pytest.mark.parametrize("seed", range(12))
def test_every_window_has_one_anchor_that_its_content_decides(seed):
    rng = np.random.default_rng(seed)
    letters = list("abcdefé")[: int(rng.integers(1, 7))]
    base = [" ".join(rng.choice(letters, int(rng.integers(0, 90)))) for _ in range(5)]
    rows = base + [b[2:] + " q " + b for b in base] + ["", " ", "x"]
    equal_windows_have_equal_anchors(rows, int(rng.integers(3, 12)), recompress.word_runs, str.split)
    joined = ["".join(r.split()) for r in rows] + ["a" * 150, "ab" * 90]
    equal_windows_have_equal_anchors(joined, int(rng.integers(8, 80)), suffixes.byte_runs, str.encode)


@pytest.mark.parametrize("width", [1, 2, 5, 7, 13])
def test_byte_windows_of_any_width_have_anchors(width):
    rng = np.random.default_rng(width)
    rows = ["".join(rng.choice(list("abé"), int(rng.integers(0, 60)))) for _ in range(9)] + ["", "a" * 40, "ab" * 20]
    equal_windows_have_equal_anchors(rows, width, suffixes.byte_runs, str.encode)


def test_a_run_of_byte_windows_is_long():
    rng = np.random.default_rng(4)
    prose = ["".join(rng.choice(list("etaoin shrdlu"), 20_000)) for _ in range(5)]
    runs = suffixes.byte_runs(whole(prose), 400)
    assert sum(runs.high - runs.low + 1) == 5 * (20_000 - 399)
    assert len(runs.low) < 100_000 / 70  # every run is a row of the first shuffle


def test_prints_of_bytes_do_not_depend_on_place_or_length():
    rng = np.random.default_rng(6)
    piece = rng.integers(0, 256, 700).astype(np.uint8)
    prime, want = int(text.PRIME), []
    for lane in (2, 3):
        want.append(sum((b + 1) * pow(text.PRIME_BASES[lane], k, prime) for k, b in enumerate(piece.tolist())) % prime)
    for before in (0, 3, 1 << 23):  # sums of so many terms are reduced first
        data = np.concatenate([np.full(before, 255, np.uint8), piece])
        got = text.BytePrints(data, 1).of(np.array([before]), np.array([before + 700]))
        assert got == text.mix(np.array([want[0] << 31 | want[1]], np.uint64))


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(1)
    for _ in range(20):
        rows = rng.integers(0, 3, (int(rng.integers(1, 700)), int(rng.integers(1, 4)))).astype(np.uint64)
        order = suffixes.multikey_quicksort(rows)
        assert [tuple(r) for r in rows[order]] == sorted(map(tuple, rows)) and len(set(order)) == len(rows)


def test_cuts_cost_no_more_than_any_others():
    rng = np.random.default_rng(2)
    width = 1024

    def price(size):
        return 0 if size >= 256 and size & (size - 1) == 0 else width - size

    for _ in range(60):
        ends = np.cumsum(rng.integers(1, 900, 25))
        position, penalty = packing.cut_points(ends, np.unique(rng.integers(1, ends[-1], 8)), width)
        best = [0]
        for j in range(1, len(position)):
            best.append(
                min(
                    best[i] + price(position[j] - position[i]) + penalty[j] + packing.WINDOW_COST
                    for i in range(j)
                    if position[j] - position[i] <= width
                )
            )
        chosen = packing.choose(position, penalty, width)
        cost = sum(
            price(position[b] - position[a]) + penalty[b] + packing.WINDOW_COST
            for a, b in zip(chosen[:-1], chosen[1:], strict=True)
        )
        assert cost == best[-1]


def test_encoder_equals_encoding_whole_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoder = packing.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = ["Hello there. It's fine!", "", " a", "a  b", "a\n b", "x \ny", "tail ", "don't we're\n\nok", "\t", "éa ñb c"]
    for _ in range(2):
        ids, sizes, _ = encoder.encode(rows)
        at = 0
        for row, n in zip(rows, sizes.tolist(), strict=True):
            assert ids[at : at + n].tolist() == encoder.tokenizer.encode(row, add_special_tokens=False).ids, row
            at += n
        assert at == len(ids)


def test_fingerprint_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 256, (40, 8)).astype(np.uint8)
    rows = items[rng.integers(0, 40, 300)].copy()
    flips = rng.random((300, 64)) < rng.random((300, 1)) * 0.6
    rows ^= np.packbits(flips, axis=1)
    row, item = contamination.Index(items, radius=20).candidates(rows)
    apart = np.unpackbits(rows[:, None, :] ^ items[None, :, :], axis=2).sum(axis=2)
    assert set(zip(row.tolist(), item.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(apart <= 20)), strict=True))


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 2.5, 7.9, 8.0, 100.5, 1e6])
    assert np.allclose(contextlm.gammaln(x), [math.lgamma(v) for v in x], atol=1e-9)


def plain_tree(grams, context):
    """Probability of every byte after ``context`` (nearest last), by the recursive definition."""
    depth = contextlm.DEPTH

    def counts(suffix, prefix):
        found = [0, 0]
        for (before, byte), n in grams.items():
            bits = f"{byte:08b}"
            if before[depth - len(suffix) :] == suffix and bits.startswith(prefix):
                found[int(bits[len(prefix)])] += n
        return found

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_weighted(suffix, prefix):
        own = log_kt(*counts(suffix, prefix))
        if len(suffix) == depth:
            return own
        longer = {before[depth - len(suffix) - 1 :] for before, _ in grams if before[depth - len(suffix) :] == suffix}
        below = sum(log_weighted(s, prefix) for s in longer)
        return np.logaddexp(own, below) - math.log(2)

    def one(suffix, prefix):
        a, b = counts(suffix, prefix)
        kt = (b + 0.5) / (a + b + 1)
        if len(suffix) == depth:
            return kt
        share = math.exp(log_kt(a, b) - math.log(2) - log_weighted(suffix, prefix))
        return share * kt + (1 - share) * one(context[depth - len(suffix) - 1 :], prefix)

    out = []
    for byte in range(256):
        bits, p = f"{byte:08b}", 1.0
        for k in range(8):
            q = one((), bits[:k])
            p *= q if bits[k] == "1" else 1 - q
        out.append(p)
    return out


def test_context_tree_predicts_by_its_definition():
    rng = np.random.default_rng(4)
    counts = np.zeros(contextlm.CELLS, np.int64)
    grams = collections.Counter()
    for _ in range(60):
        context, byte = tuple(int(v) for v in rng.integers(0, 2, 3)), int(rng.integers(96, 100))
        grams[context, byte] += 1
        counts[((context[0] * 32 + context[1]) * 32 + context[2]) * 256 + byte] += 1
    table = contextlm.predictions(counts).reshape(-1, 256)
    for context in ((0, 1, 1), (1, 0, 0), (5, 5, 5)):
        row = table[(context[0] * 32 + context[1]) * 32 + context[2]]
        want = plain_tree(grams, context)
        assert np.allclose(row[90:105], np.log10(want)[90:105], atol=1e-4)
        assert abs((10 ** row.astype(float)).sum() - 1) < 1e-4


def test_alnum_words_match_the_pattern():
    rows = ["It's  Fine, é-ñ 12.5", "", "..", " x_y"]
    t = whole([r.lower() for r in rows])
    words = text.split(t, text.NOT_ALNUM)
    plain = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.lower()) for r in rows]
    assert words.counts.tolist() == [len(p) for p in plain]
    assert hashlib.sha256(b"".join(bytes(t.data[a:b]) for a, b in zip(words.start, words.end, strict=True))).digest() == hashlib.sha256("".join(sum(plain, [])).encode()).digest()
