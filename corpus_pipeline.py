"""The corpus pipeline: five stages over ``documents``, each one operator.

Every stage reads its predecessor's rows from Parquet, works on all of them
and writes its own. All stages but the last return the columns of documents.

1. language ID: documents go whose mixture is no likelier with any language
   than without one.
2. exact dedup: of equal texts the longest row with the smallest id stays.
3. n-gram Jaccard join: of each class of near copies the smallest id stays.
4. mixing: every document as often as the mix takes it, at most three times,
   each file in the order of the schedule's slots; the last document of a
   source's share stays if half of it or more is taken.
5. SentencePiece: sampled piece ids (``pieces``) beside the columns.

Cases: null and empty texts go in stage 1; stages 2 and 3 keep or drop single
rows, whatever their ids: of rows that repeat a text one stays, one with an id
if there is any, and rows that repeat an id with other texts stay beside each
other; an empty table passes as an empty table; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import exact_dedup, langid, mixing, ngram_join, piece_lattice
from sigspark.llm.common import new_path, row_keyed, ship, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(docs: DataFrame) -> DataFrame:
    """The stage's input with a key of its own (``row``) for every row."""
    return row_keyed(docs, *COLUMNS)


def _first_of_each(rows: DataFrame, classes: DataFrame, *order) -> DataFrame:
    """The rows without those that come after another one of their class
    (``classes``: row, class), in the given order, then by id and row."""
    rank = F.struct(*order, F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    members = stored(rows.select("row", rank.alias("rank")).join(classes, "row"), "pipeline-classes")
    first = members.groupBy("class").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("row"))
    gone = members.select("row").join(first, "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the stage's own rows with a language; rejects texts without
    a letter and those whose mixture keeps no language."""
    ship(spark)
    model = langid.train(docs)
    return langid.filter_accepted(docs.select(*COLUMNS), model)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = _rows(docs)
    found = exact_dedup.exact_dedup(rows, "row", hash_all=True).where("group_size > 1")
    return _first_of_each(rows, found.select(F.col("id").alias("row"), F.col("keep_id").alias("class")),
                          (-F.length("text")).alias("short"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = _rows(docs)
    found = ngram_join.jaccard_join(rows, "row").where("n_links > 0")
    return _first_of_each(rows, found.select(F.col("id").alias("row"), F.col("class_id").alias("class")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, once per epoch that takes them; every file
    has the order of the first slots that hold its documents."""
    ship(spark)
    rows = _rows(docs)
    sizes, _, spans = mixing.schedule(rows, row_col="row")
    taken = (spans.groupBy(*mixing.KEY, "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
             .where("2 * words >= size"))
    copies = sizes.alias("s").join(taken.alias("t"), mixing.same_key("s", "t")).select("s.row", "t.slot")
    return rows.join(copies, "row").sortWithinPartitions("slot", "row").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ship(spark)
    return piece_lattice.with_pieces(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("ngram_join", near_duplicates),
    ("mixing", mix),
    ("sentencepiece", pieces),
]

#: Trained language models and sampled pieces are beyond SQL; the tests hold
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
