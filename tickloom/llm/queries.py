"""The named queries of the corpus operators, on the tables of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    classify,
    collocation_sql,
    collocations,
    contamination,
    contextlm,
    licenses,
    metricjoin,
    minhash,
    packing,
    personal,
    prefixtrie,
    recompress,
    rollup,
    suffixes,
)
from tickloom.session import checkpoint_dir, materialised

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled rows outside the held-out third."""
    held_out = F.coalesce(classify.remainder("doc_id", 3) == 1, F.lit(False))
    scored = classify.classify(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), learn=~held_out
    )
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under words and under the context tree."""
    held_out = F.coalesce(classify.remainder("doc_id", 7) == 2, F.lit(False))
    scored = contextlm.score(read(spark, sf_dir, "documents"), learn=~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
        "score", "bits_per_byte",
    )


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens; a piece's ids as their checksum."""
    import public_tokenizers

    pieces = packing.pack(
        read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), width=2048
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan(read(spark, sf_dir, "documents")).drop("matches")


ORACLES["op7_license_scan"] = licenses.oracle()


@query
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


ORACLES["op3_minhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT l.doc_id AS a, r.doc_id AS b, l.n AS na, r.n AS nb, count(*) AS c
  FROM e AS l JOIN e AS r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, k.b FROM reach AS r JOIN k ON r.b = k.a),
g AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, g.component_id, s.doc_id = g.component_id AS kept
FROM s JOIN g ON s.doc_id = g.a"""


@query
def op1_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near vectors of one label."""
    return metricjoin.near_vectors(read(spark, sf_dir, "embeddings"))


ORACLES["op1_metric_join"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
k AS (SELECT l.vec_id AS a, r.vec_id AS b FROM v AS l JOIN v AS r
  ON l.label = r.label AND l.vec_id <> r.vec_id AND len(l.v) = len(r.v)
  WHERE list_cosine_similarity(l.v, r.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, k.b FROM reach AS r JOIN k ON r.b = k.a),
g AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM k GROUP BY a)
SELECT g.a AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, g.a = component_id AS kept
FROM g LEFT JOIN n ON n.a = g.a"""


@query
def op2_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated windows; what is left as its checksum."""
    cut = recompress.substring_dedup(read(spark, sf_dir, "documents"), width=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op2_recompression"] = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35),
h AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM p),
d AS (SELECT r, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM d),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r),
u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT u.r, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN c ON u.r = c.r AND u.i = c.i
  WHERE c.r IS NULL GROUP BY u.r)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN n ON w.r = n.r LEFT JOIN k ON w.r = k.r"""


@query
def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated strings; what is left as its checksum."""
    cut = suffixes.byte_dedup(read(spark, sf_dir, "documents"), width=400)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of benchmark items in documents: a row per document and item."""
    return contamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents in; toxic ones out; junk recounted without repeated lines."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    once = F.when(
        F.size(F.array_distinct(lines)) < F.size(lines), F.array_join(F.array_distinct(lines), "\n")
    ).otherwise(text)

    def counted(column: str) -> DataFrame:
        pairs = [[F.lit(v), rollup.count_tokens(F.col(column), s)] for v, s in rollup.SEPARATORS.items()]
        return F.create_map(*[c for pair in pairs for c in pair])

    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", text.alias("_all"), once.alias("_once"))
    docs = materialised(docs.select("doc_id", "source", "lang", counted("_all").alias("n"), counted("_once").alias("fewer")))
    labels = read(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    junk = labels.where("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti")
    totals = rollup.Rollup(spark, f"{checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}")
    removed = rollup.changes(docs.join(toxic, "doc_id", "left_semi"), "n", None)
    totals.commit("load", rollup.changes(docs, None, "n"))
    totals.commit("toxic", removed)
    totals.commit("toxic", removed)  # a repeated delivery
    totals.commit("junk", rollup.changes(docs.join(junk, "doc_id", "left_semi"), "n", "fewer"))
    return totals.totals(["load", "toxic", "junk"])


ORACLES["op9_token_counts"] = r"""
WITH v AS (SELECT 'white-1' AS version, '[\x20\x09-\x0D]+' AS s
  UNION ALL SELECT 'alnum-1', '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
x AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
j AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM x)),
d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents
  WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM x)),
l AS (SELECT r, doc_id IN (SELECT doc_id FROM j) AS junk, unnest(string_split(t, chr(10))) AS line FROM d),
k AS (SELECT r, line FROM l WHERE NOT coalesce(junk, false) UNION ALL SELECT DISTINCT r, line FROM l WHERE junk),
n AS (SELECT r, v.version, sum(len(list_filter(regexp_split_to_array(line, v.s), lambda w: w <> ''))) AS n
  FROM k, v GROUP BY r, v.version)
SELECT source, lang, version, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM d JOIN n ON d.r = n.r GROUP BY source, lang, version"""


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of two and three words of each language."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = collocation_sql.ORACLE


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return prefixtrie.prefix_trie(read(spark, sf_dir, "conversations"))


@query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: fixed formats, and what boosted trees add."""
    found = personal.personal_data(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *personal.digests(found))
