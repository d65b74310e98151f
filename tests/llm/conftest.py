from __future__ import annotations

import pytest

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "_id string, row string, w string, key string, parts string, kept string, component string, x string"
)


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), *["clash"] * 8) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree "
    "near the river bank where children play every summer evening until the moon climbs above hills "
    "and lanterns glow softly along narrow winding paths that lead toward a quiet village square"
).split()


@pytest.fixture(scope="session")
def awkward():
    """Rows every operator has to survive: nulls, empties, blanks, repeats, one very long text."""
    prose = " ".join(PROSE)
    return [
        (1, prose),
        (2, prose),
        (2, prose),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (None, prose + " tail"),
        (None, None),
        (6, "one"),
        (7, " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))),
        (8, "a " * 300),
        (9, "Ünïcödé   wörds here\nunder the MIT License\n"),
    ]
