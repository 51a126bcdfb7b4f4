"""Operator 3, exact dedup by progressive refinement (DataFrame functions only).

Texts are equal when identical without white space (``common.SPACE_CLASS``).
Rows are told apart by ever dearer keys, and only rows that still share a key
go on to the next one:

1. length of the normalised text,
2. length and hash of its first ``prefix_chars`` characters,
3. SHA-256 of the whole normalised text.

Every level is a count that combines before its shuffle, followed by a semi
join that Spark may split, so one length, prefix or text that holds a third
of all rows is no hot task. Texts are never shuffled by the levels: only
lengths, hashes and ids move.

Cases: null text counts as empty, and all empty texts are equal; a null id is
kept as a row (it never wins over a given id); rows that repeat an id are all
marked like the first; an empty table gives an empty result; further columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, row_keyed, stored, table


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, "")


def signatures(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int,
               hash_all: bool) -> DataFrame:
    """One narrow row per document; the only pass over all texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("raw"),
                       normalised(F.col(text_col)).alias("norm"), *([] if hash_all else ["row"]))
    cols = ["id", *([] if hash_all else ["row"]), F.length("raw").alias("n_raw"), F.length("norm").alias("n_norm"),
            F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix")]
    return rows.select(*cols, *([F.sha2(F.col("norm"), 256).alias("sha")] if hash_all else []))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = 64, hash_all: bool = False) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept (, sha).

    Of equal texts the one with the most characters before normalising, then
    the smallest id stays. With ``hash_all`` the first pass also hashes every
    text, for callers that need each digest; otherwise level 3 reads the
    texts of surviving rows only (one join that carries texts; rows are told
    apart by their place in the input, so ids may repeat or be null).
    """
    if not hash_all:
        docs = row_keyed(docs, id_col, text_col)
    sig = stored(signatures(docs, id_col, text_col, prefix_chars, hash_all), "dedup-sig")
    lengths = sig.groupBy("n_norm").count().where("count > 1").select("n_norm")
    level1 = stored(sig.join(lengths, "n_norm", "left_semi"), "dedup-length")
    prefixes = (level1.groupBy("n_norm", "prefix").count().where("count > 1")
                .select("n_norm", "prefix"))
    level2 = stored(level1.join(prefixes, ["n_norm", "prefix"], "left_semi"), "dedup-prefix")
    if hash_all:
        level3 = level2
    else:
        texts = docs.select("row", F.col(id_col).cast("long").alias("id"),
                            F.coalesce(F.col(text_col), F.lit("")).alias("raw"),
                            normalised(F.col(text_col)).alias("norm"))
        level3 = stored(texts.join(level2.select("row"), "row", "left_semi")
                        .select("row", "id", F.length("raw").alias("n_raw"),
                                F.sha2(F.col("norm"), 256).alias("sha")), "dedup-full")
    by_length = level3.groupBy("sha", "n_raw").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    classes = (by_length.groupBy("sha")
               .agg(F.sum("n").alias("group_size"), F.max_by("first", "n_raw").alias("keep_id"))
               .where("group_size > 1"))
    if hash_all:
        marked = sig.select("id", "sha").join(classes, "sha", "left")
        out = ["id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
               F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "sha"]
        marked = marked.select(*out)
    else:
        found = level3.select("row", "sha").join(classes, "sha").select("row", "keep_id", "group_size")
        marked = (sig.select("row", "id").join(found, "row", "left")
                  .select("id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                          F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")))
    return marked.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                        F.col("sha").alias("text_sha256"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_raw,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY h ORDER BY n_raw DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       first_value(doc_id) OVER (PARTITION BY h ORDER BY n_raw DESC, doc_id) = doc_id AS kept,
       h AS text_sha256
FROM n
"""
