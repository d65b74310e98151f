"""License scan: which text blocks contain enough of a license template, by an exact set join.

A block is a line, or a window of words that runs over line ends, long enough for the template and the
foreign words its threshold allows (a notice is often wrapped). Template tokens are ordered by how many words of the whole corpus they make up,
rarest first. A block that holds a share ``threshold`` of a template's n tokens misses at most
n - ceil(threshold * n) of them, so it holds one of the first n - ceil(threshold * n) + 1 (prefix
filter), has at least ceil(threshold * n) distinct tokens (length filter), and from the position of
the first token it holds, enough must remain (positional filter). Blocks without a prefix token are
dropped while the text is scanned; the others are joined to the templates by prefix token and
verified on whole sets; windows are taken at every step around a prefix token. Only DataFrame functions are used, and text is never shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import materialised

#: The phrases whose places are reported, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices by which works commonly state their license, with a label each.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial 4 0 international": "cc-by-nc",
    "gnu general public license version 3": "gpl-3",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
}
THRESHOLD = 0.75
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower case.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def lowered(text: Column) -> Column:
    """Lower case in which only A-Z become ASCII letters; null becomes empty."""
    kept = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å"))
    return F.lower(F.replace(kept, F.lit("İ"), F.lit("é")))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def word_pattern(choices: list[str]) -> str:
    """A pattern for any of some words or phrases standing as whole words, ASCII case aside."""
    parts = "|".join((RAW_SEPARATORS + "+").join(c.split()) for c in choices)
    return f"(?i)(?:^|{RAW_SEPARATORS})(?:{parts})(?:$|{RAW_SEPARATORS})"


def token_counts(docs: DataFrame, tokens: list[str], text_col: str = "text") -> dict[str, int]:
    """How many words of all texts each of the given tokens makes up."""
    words = docs.select(F.explode(F.split(lowered(F.col(text_col)), SEPARATORS)).alias("w"))
    rows = words.where(F.col("w").isin(tokens)).groupBy("w").count().collect()
    found = {r["w"]: r["count"] for r in rows}
    return {t: found.get(t, 0) for t in tokens}


def places(words: Column, phrase: str) -> Column:
    """Indices of ``words`` (a stored column) at which the phrase's words stand one after another."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(words, i + j) == p for j, p in enumerate(parts)])

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def scan(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: phrase places, and labels of all templates some block contains.

    Returns ``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels``, ``score`` (1 with a phrase, else the best template share that meets the threshold,
    else 0) and ``matches`` (array of label, line number, share; the number is null for a window of words). Null text counts as empty. Null
    and repeated ids are kept, a row each. Extra columns are ignored; an empty table gives no rows.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    sets = {t: sorted(set(t.split())) for t in templates}
    # at most one count for each template token
    counts = token_counts(docs, sorted({w for s in sets.values() for w in s}), text_col)
    prefix_rows, prefixes = [], set()
    for template, tokens in sets.items():
        ordered = sorted(tokens, key=lambda w: (counts[w], w))
        need = math.ceil(threshold * len(ordered) - 1e-9)
        for place, token in enumerate(ordered[: len(ordered) - need + 1]):
            prefixes.add(token)
            length = math.ceil(len(template.split()) / threshold - 1e-9)
            prefix_rows.append((token, templates[template], place, ordered, need, length))
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = F.split(text, RAW_SEPARATORS + "+")
    count = F.size(pieces)
    edges = (F.get(pieces, F.lit(0)) == "").cast("int") + ((count > 1) & (F.get(pieces, count - 1) == "")).cast("int")
    rare = word_pattern(sorted(prefixes))
    lines = F.filter(
        F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("block"), line.alias("line"))),
        lambda s: s["line"].rlike(rare),
    )
    # one pass over the text: what few documents need further on is stored
    scanned = materialised(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(id_col).alias("_id"),
            (count - edges).cast("long").alias("n_words"),
            F.when(text.rlike(word_pattern(list(phrases))), words_of(lowered(text)))
            .otherwise(F.array().cast("array<string>"))
            .alias("words"),
            F.when(text.rlike(rare), lines)
            .otherwise(F.array().cast("array<struct<block:int,line:string>>"))
            .alias("lines"),
            F.when(text.rlike(rare) & text.contains("\n"), words_of(lowered(text)))
            .otherwise(F.array().cast("array<string>"))
            .alias("wrapped"),
        )
    )

    def found(phrase: str, label: str) -> Column:
        return F.transform(
            places(F.col("words"), phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))
        )

    scanned = scanned.withColumn("base", F.concat(*[found(p, v) for p, v in phrases.items()]))
    rows = [
        F.struct(
            F.lit(token).alias("token"),
            F.lit(label).alias("label"),
            F.lit(place).alias("place"),
            F.array(*map(F.lit, template)).alias("template"),
            F.lit(need).alias("need"),
            F.lit(length).alias("length"),
        )
        for token, label, place, template, need, length in prefix_rows
    ]
    prefix = spark.range(1).select(F.inline(F.array(*rows)))
    blocks = scanned.select("_row", F.explode("lines").alias("b")).select(
        "_row", "b.block", F.array_distinct(words_of(lowered(F.col("b.line")))).alias("tokens")
    )
    held = blocks.select("*", F.explode("tokens").alias("token")).join(prefix, "token")
    fitting = held.where(
        (F.size("tokens") >= F.col("need")) & (F.size("template") - F.col("place") >= F.col("need"))
    )
    share = F.size(F.array_intersect("tokens", "template")) / F.size("template")
    # only the words about a prefix token leave the scan: no row carries a whole text
    length, reach = F.col("length"), max(row[-1] for row in prefix_rows) if prefix_rows else 1
    spots = F.filter(
        F.transform("wrapped", lambda w, i: F.struct(i.alias("at"), w.alias("token"))),
        lambda s: s["token"].isin(sorted(prefixes)),
    )
    around = (
        scanned.where(F.size("wrapped") > 0)
        .select("_row", "wrapped", F.explode(spots).alias("s"))
        .select(
            "_row", "s.token", F.least(F.col("s.at"), F.lit(reach - 1)).alias("at"),
            F.slice("wrapped", F.greatest(F.col("s.at") - reach + 2, F.lit(1)), 2 * reach - 1).alias("near"),
        )
        .join(F.broadcast(prefix), "token")  # a few rows a template
        .where(F.size("template") - F.col("place") >= F.col("need"))
        .withColumn("near", F.slice("near", F.greatest(F.col("at") - length + 2, F.lit(1)), 2 * length - 1))
    )
    windows = F.transform(
        F.sequence(F.lit(1), length),
        lambda k: F.size(F.array_intersect(F.slice("near", k, length), "template")) / F.size("template"),
    )
    over = around.select(
        "_row", F.lit(None).cast("int").alias("block"), "label", "need",
        F.array_max(windows).alias("share"), F.size("template").alias("size"),
    )
    matches = (
        fitting.select("_row", "block", "label", "need", share.alias("share"), F.size("template").alias("size"))
        .unionByName(over)
        .where(F.round(F.col("share") * F.col("size")) >= F.col("need"))
        .groupBy("_row", "block", "label")
        .agg(F.max("share").alias("share"))
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct("label", "block", "share"))).alias("matches"))
    )
    none = F.array().cast("array<struct<label:string,block:int,share:double>>")
    out = scanned.join(matches, "_row", "left").withColumn("matches", F.coalesce("matches", none))
    at = F.col("base")["at"].cast("array<long>")
    own, added = F.col("base")["label"], F.col("matches")["label"]
    best = F.coalesce(F.array_max(F.col("matches")["share"]), F.lit(0.0))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, added)).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        "matches",
    )


def oracle(phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB, without filters: every line against every template (windows over line ends are not in it)."""
    def array(items) -> str:
        return "[" + ", ".join(f"'{x}'" for x in items) + "]"

    found = " UNION ALL ".join(
        f"SELECT r, i - 1 AS spot, '{label}' AS label FROM (SELECT r, w, unnest(range(1, len(w) - {len(p.split()) - 2})) AS i FROM d) "
        f"WHERE list_slice(w, i, i + {len(p.split()) - 1}) = {array(p.split())}"
        for p, label in phrases.items()
    )
    wanted = " UNION ALL ".join(
        f"SELECT {array(sorted(set(t.split())))} AS tokens, '{label}' AS label" for t, label in templates.items()
    )
    split = r"list_filter(regexp_split_to_array({0}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
d AS (SELECT r, doc_id, {split.format("s")} AS w FROM t),
p AS ({found}),
l AS (SELECT r, {split.format("b")} AS w FROM (SELECT r, unnest(string_split(s, chr(10))) AS b FROM t)),
m AS (SELECT r, label, len(list_intersect(list_distinct(w), tokens)) / len(tokens) AS share
  FROM l, ({wanted}) AS v),
b AS (SELECT r, count(*) AS n, min(spot) AS first, max(spot) AS last,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM
  (SELECT r, label FROM p UNION ALL SELECT r, label FROM m WHERE share >= {threshold}) GROUP BY r),
s AS (SELECT r, max(share) AS share FROM m WHERE share >= {threshold} GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base,
  CAST(b.first AS BIGINT) AS first_word, CAST(b.last AS BIGINT) AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(s.share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b ON d.r = b.r LEFT JOIN a ON d.r = a.r LEFT JOIN s ON d.r = s.r"""
