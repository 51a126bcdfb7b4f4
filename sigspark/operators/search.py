"""Text search by an index (F10): many phrases or regular expressions at once.

The index has three stored tables, each sorted by its key inside its files, with
delta-coded pages; postings and words are dealt by word, grams stay with their
words:

* postings (word, block, bits): a word is a run without white space, A-Z in
  lower case; a block is 64 consecutive ids and ``bits`` has one bit for each id
  whose text holds the word. A row is one long whatever the word, so a word in
  every text costs a row for each block and is combined before the shuffle.
* words (word, n): the different words and the number of ids that hold them.
* grams (gram, word): the different runs of three characters of each word.

A search is reduced to pieces that every match must hold: what lies between the
operators of a regular expression, cut at white space. A piece with white space
on both sides is a whole word; another one is looked up by its rarest run of
three characters and then compared with the words themselves. The bits of a
piece's words are united, those of the rarest ``PIECES`` pieces are intersected,
and only ids that remain are verified against their whole texts. What the
reduction does not understand (groups, classes, optional parts) it leaves out,
and a search without any piece looks at every text: pieces decide what is
verified, never a result.

Cases: a null text or pattern matches nothing, an empty pattern matches every
text, rows that repeat an id are verified one by one and give a row each, rows
without an id are one block of their own. Ids are whole numbers.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, spread, stored_once

GRAM, PIECES = 3, 4
BLOCK = 64  # bits of a long
#: Patterns without a piece that one pass over the texts tries.
SCAN_PATTERNS = 1000
TABLES = {"postings": "word string, block long, bits long", "words": "word string, n long",
          "grams": "gram string, word string"}
SPACE, BREAK = r"[ \t\n\x0B\f\r]+", "\u0001"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold(c: Column) -> Column:
    """A-Z in lower case. Only other letters need the map from character to character."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def _grams(word: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(word, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1))


def _block(key: Column) -> Column:
    return F.shiftright(key.cast("long"), BLOCK.bit_length() - 1)


def _bit(key: Column) -> Column:
    return F.coalesce(F.pmod(key.cast("long"), F.lit(BLOCK)).cast("int"), F.lit(0))


# ------------------------------------------------------------------ index --
@dataclass
class TextIndex:
    postings: DataFrame
    words: DataFrame
    grams: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextIndex:
        return cls(*[spark.read.schema(TABLES[t]).parquet(f"{path}/{t}") for t in ("postings", "words", "grams")])


def _written(df: DataFrame, path: str, table: str, *order: str) -> DataFrame:
    df.sortWithinPartitions(*order).write.option(
        "parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").parquet(f"{path}/{table}")
    return df.sparkSession.read.schema(TABLES[table]).parquet(f"{path}/{table}")


def build_index(docs: DataFrame, key: str, text: str, path: str | None = None, partitions: int | None = None) -> TextIndex:
    """Index of every word of every text, written to ``path`` (a new folder; by
    default one in the shared folder)."""
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/text-index-{uuid.uuid4().hex}"
    d = spread(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), partitions=partitions)
    held = d.select(_block(F.col("id")).alias("block"), _bit(F.col("id")).alias("bit"),
                    F.explode(F.split("text", SPACE)).alias("raw")).filter("raw <> ''")
    held = held.select("block", "bit", fold(F.col("raw")).alias("word"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    postings = _written(held.groupBy("word", "block").agg(F.bit_or(one).alias("bits")).repartition("word"), path, "postings", "word", "block")
    words = _written(postings.groupBy("word").agg(F.sum(F.bit_count("bits")).cast("long").alias("n")), path, "words", "word")
    grams = _written(words.select(F.explode(_grams(F.col("word"))).alias("gram"), "word"), path, "grams", "gram", "word")
    return TextIndex(postings, words, grams)


# -------------------------------------------------------------- reduction --
def _literals(pattern: Column) -> Column:
    """Alternatives of a regular expression, each the literal runs between its
    operators (joined by BREAK); null where the reduction does not hold."""
    p = F.regexp_replace(pattern, r"^\(\?[ism]+\)", "")
    p = F.regexp_replace(p, r"\\\\", BREAK)
    unsafe = p.rlike(r"\(\?[^:]|\\[^dDwWsSbBntrf\W_]")
    p = F.regexp_replace(p, r"\\s(?:[?*]|\{[^}]*\})[?+]*", BREAK)
    p = F.regexp_replace(p, r"\\s\+?[?+]*", " ")
    p = F.regexp_replace(p, r"(?s)\\.", BREAK)
    p = F.regexp_replace(p, r"\[[^\[\]]+\]", BREAK)
    for _ in range(6):  # groups, the innermost first
        p = F.regexp_replace(p, r"\([^()]*\)", BREAK)
    unsafe = unsafe | p.rlike(r"[\[\]()]")
    p = F.regexp_replace(p, r"(?s).(?:[?*]|\{[^}]*\})[?+*]*", BREAK)
    p = F.regexp_replace(p, r"\+[?+]*|[.^$\\{}]", BREAK)
    return F.when(~unsafe, F.split(p, r"\|"))


def pieces(queries: DataFrame, regex: bool = True) -> DataFrame:
    """query, branch, piece, left, right (white space on that side) of every
    piece that can be looked up; ``piece`` is null for a branch without one.

    ``queries``: query, pattern. A null pattern has no rows.
    """
    q = queries.select("query", "pattern").filter(F.col("pattern").isNotNull())
    branches = F.coalesce(_literals(F.col("pattern")), F.array(F.lit(""))) if regex else F.array("pattern")
    runs = F.split(F.col("literal"), BREAK) if regex else F.array("literal")

    def cut(run):
        parts = F.split(run, SPACE)
        last = F.size(parts) - 1
        return F.transform(parts, lambda p, i: F.struct(p.alias("piece"), (i > 0).alias("left"), (i < last).alias("right")))

    usable = F.filter(F.flatten(F.transform(runs, lambda r: cut(fold(r)))),
                      lambda x: (F.length(x["piece"]) >= GRAM) | ((x["piece"] != "") & x["left"] & x["right"]))
    return q.select("query", F.posexplode(branches).alias("branch", "literal")).select(
        "query", "branch", F.explode_outer(F.array_distinct(usable)).alias("p")).select("query", "branch", "p.*")


def _piece_words(found: DataFrame, index: TextIndex) -> DataFrame:
    """piece, left, right, word, n for all words that hold a piece."""
    what = found.select("piece", "left", "right").distinct()
    whole = what.filter("left AND right").join(index.words.withColumnRenamed("word", "piece"), "piece") \
                .select("piece", "left", "right", F.col("piece").alias("word"), "n")
    part = what.filter("NOT (left AND right)").withColumn("gram", F.explode(_grams(F.col("piece"))))
    count = index.grams.join(part.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("m"))
    best = part.join(count, "gram", "left").groupBy("piece", "left", "right").agg(
        F.min(F.struct(F.coalesce("m", F.lit(0)).alias("m"), "gram"))["gram"].alias("gram"))
    w, p = F.col("word"), F.col("piece")
    holds = F.when(F.col("left"), w.startswith(p)).when(F.col("right"), w.endswith(p)).otherwise(w.contains(p))
    cand = best.join(index.grams, "gram").filter(holds).select("piece", "left", "right", "word")
    return whole.unionByName(cand.join(index.words, "word").select("piece", "left", "right", "word", "n"))


def candidates(queries: DataFrame, index: TextIndex, regex: bool = True, keep: int = PIECES) -> tuple[DataFrame, DataFrame]:
    """(query, block, bits: ids that hold the rarest pieces of some branch,
    branches: branch and bits of each; query: those of which every text must be
    verified)."""
    found = stored_once(pieces(queries, regex), "pieces")
    scan = found.filter("piece IS NULL").select("query").distinct()
    indexed = found.join(scan, "query", "left_anti")
    key = ["piece", "left", "right"]
    words = stored_once(_piece_words(indexed, index), "piece-words")
    n = words.groupBy(*key).agg(F.sum("n").alias("n"))
    order = Window.partitionBy("query", "branch").orderBy("n", *key)  # the pieces of one pattern
    rarest = indexed.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rarest.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    need = Window.partitionBy("query", "branch")
    rarest = stored_once(rarest.withColumn("need", F.count("*").over(need)).withColumn("least", F.min("n").over(need))
                         .filter("least > 0").select("query", "branch", "need", *key), "rarest")
    used = words.join(rarest.select(*key).distinct(), key, "left_semi")
    held = index.postings.join(used, "word").groupBy(*key, "block").agg(F.bit_or("bits").alias("bits"))
    both = held.join(rarest, key).groupBy("query", "branch", "need", "block").agg(
        F.bit_and("bits").alias("bits"), F.count("*").alias("have"))
    some = both.filter("have = need AND bits <> 0").groupBy("query", "block").agg(
        F.bit_or("bits").alias("bits"), F.collect_list(F.struct("branch", "bits")).alias("branches"))
    return some, scan


# ----------------------------------------------------------------- search --
def _alternatives(pattern: Column) -> Column:
    """The branches of a regular expression as expressions of their own; null
    where a bar may stand for something else (groups, classes, quotes)."""
    rest = F.regexp_replace(pattern, r"\[\^?[A-Za-z0-9 _-]+\]", "")  # simple classes
    plain = ~rest.rlike(r"[\[\]()]|\\[\\|QEk]")
    return F.when(plain, F.split(pattern, r"\|"))


def _matches(text: Column, pattern: Column, regex: bool, case: bool) -> Column:
    if regex:
        return F.regexp_like(text, pattern if case else F.concat(F.lit("(?i)"), pattern))
    return text.contains(pattern) if case else fold(text).contains(fold(pattern))


def search_all(docs: DataFrame, queries: DataFrame, key: str, text: str, index: TextIndex | None = None,
               regex: bool = True, case: bool = True, keep: int = PIECES) -> DataFrame:
    """F10 for a table of searches: (query, ``key``) for every row whose whole
    text matches the pattern of a query.

    ``queries``: query, pattern (query is its key). ``index``: that of the same
    ``docs``, built here if not given. ``case``: False takes a-z and A-Z alike.
    """
    index = index or build_index(docs, key, text)
    d = spread(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()))
    some, scan = candidates(queries, index, regex, keep)
    q = queries.select("query", "pattern")
    hit = _matches(F.col("text"), F.col("pattern"), regex, case)
    if regex:  # an id is tried with the branches whose pieces it holds: one of them is quicker than all at once
        q = q.withColumn("alone", _alternatives(F.col("pattern")))  # once a query, not once a candidate
        own = F.exists("branches", lambda b: (F.getbit(b["bits"], F.col("bit")) == 1) & _matches(
            F.col("text"), F.get(F.col("alone"), b["branch"]), regex, case))
        hit = F.when(F.col("alone").isNull(), hit).otherwise(own)
    texts = d.withColumns({"block": _block(F.col("id")), "bit": _bit(F.col("id"))})
    # one row for each id, so that no pattern is tried before the id is known to fit
    held = F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.getbit("bits", i) == 1)
    c = some.select("query", F.col("block").alias("of"), "branches", F.explode(held).alias("at")).join(q, "query")
    out = texts.join(c, F.col("block").eqNullSafe(F.col("of")) & (F.col("bit") == F.col("at"))).filter(hit).select("query", "id")

    rest = q.select("query", "pattern").join(scan, "query", "left_semi")
    parts = -(-rest.count() // SCAN_PATTERNS)
    for part in range(parts):
        mine = rest if parts == 1 else rest.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == part)
        row = mine.agg(F.collect_list(F.struct("query", "pattern")).alias("qs"))  # SCAN_PATTERNS, about
        hits = F.filter("qs", lambda x: _matches(F.col("text"), x["pattern"], regex, case))
        out = out.unionByName(d.crossJoin(F.broadcast(row)).select(F.explode(hits).alias("h"), "id").select("h.query", "id"))
    return out.withColumnRenamed("id", key)
