"""Token counts kept as rollups that deltas maintain.

Changes of documents are signed: an insert adds its tokens, a delete takes them away, a revision
does both. A batch of changes is reduced to one row of sums per source, language and tokenizer
version (partial sums first, so a source with a third of all rows is no burden) and committed under
its batch id. A batch counts once: a commit of an id that is already committed changes nothing, and
what a failed commit left behind is overwritten. Totals are the sums over committed batches, so a
batch costs what it changes, not what the corpus holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "version")
DELTA = "source string, lang string, version string, n_docs long, n_tokens long"

#: Tokenizer versions that plain expressions count: words between white space, words of letters.
SEPARATORS = {"white-1": r"[\x20\x09-\x0D]+", "alnum-1": r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}


def count_tokens(text: Column, separators: str) -> Column:
    """Number of tokens between runs of separators; none in null or empty text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")).cast("long")


def changes(docs: DataFrame, old: str | None, new: str | None) -> DataFrame:
    """Signed changes of documents from maps of version to tokens: no ``old`` inserts, no ``new`` deletes.

    A null map or count is no change of tokens; null sources and languages are keys of their own.
    """
    parts = []
    for column, sign in ((old, -1), (new, 1)):
        if column is not None:
            counts = docs.select("source", "lang", F.explode(column).alias("version", "tokens"))
            parts.append(
                counts.select(
                    *KEYS,
                    F.lit(sign).cast("long").alias("n_docs"),
                    (F.coalesce("tokens", F.lit(0)) * sign).cast("long").alias("n_tokens"),
                )
            )
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


class Rollup:
    """Totals under ``path``, in the shared folder of the cluster."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def committed(self, batch: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch}/_SUCCESS")
        return mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of signed changes; False, and no change, if its id is committed already."""
        if self.committed(batch):
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.where("n_docs <> 0 OR n_tokens <> 0").write.mode("overwrite").parquet(
            f"{self.path}/batch={batch}"
        )
        return True

    def totals(self, batches: list[str]) -> DataFrame:
        """Sums over the named batches; keys whose documents are all gone are left out."""
        paths = [f"{self.path}/batch={b}" for b in batches if self.committed(b)]
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*paths)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")
