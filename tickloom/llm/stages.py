"""The corpus pipeline: stages applied one after another, each written as Parquet and read again.

A row is named by a hash of its id and text where a stage decides row by row, so null and repeated
ids are decided by their own text; rows equal in both share a decision.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import classify, contamination, minhash, packing, recompress
from tickloom.session import checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOKENIZER = "byte_bpe_50k.json"
SUBSTRING_WORDS = 35
WINDOW_TOKENS = 2048

def fresh(docs: DataFrame, stem: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (f"_{stem}{k}" for k in range(len(taken) + 1)) if n not in taken)


def name(own: str) -> Column:
    return F.xxhash64("doc_id", "text").alias(own)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of ``sf_dir``, does not reject.

    Null and empty texts are scored like any other. Columns and rows are otherwise unchanged; an
    empty table stays empty; without labels of both classes nothing is rejected.
    """
    own = fresh(docs, "name")
    named = docs.select("doc_id", "text", name(own))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    taught = labels.join(named.select("doc_id", own), "doc_id").select(own, "quality")
    kept = classify.classify(named, taught, id_col=own).where("predicted = 1").select(own).distinct()
    return docs.select("*", name(own)).join(kept, own, "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group.

    Rows that repeat an id and its text are one document; rows without an id all stay.
    """
    groups = minhash.near_duplicates(docs)
    kept = groups.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.where("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows of 35 that occur elsewhere too.

    A text that loses words is what is left, joined by single spaces; others are as they were.
    ``n_chars`` follows the text. Null texts stay null.
    """
    # The other columns travel as one, under a name of their own.
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"))
    cut = recompress.substring_dedup(whole, width=SUBSTRING_WORDS, carry=("_whole",))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_whole.text"))
    length = F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    made = {"text": text, "n_chars": length}
    return cut.select(*[made.get(c, F.col(f"_whole.`{c}`")).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark of ``sf_dir``.

    Null and empty texts hold no passage and stay, repeated rows stay or go together; other columns, whatever
    their names, and an empty table are left as they are.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own = fresh(docs, "name")
    found = contamination.contaminated(docs.select("text", name(own)), benchmark, id_col=own)
    leaks = found.select(own).distinct()
    return docs.select("*", name(own)).join(leaks, own, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, in windows of 2048 tokens.

    A null or empty text is one piece of one id; every repeated row is packed; other columns are not read;
    an empty table has no piece.
    """
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path(TOKENIZER)), width=WINDOW_TOKENS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; every stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
