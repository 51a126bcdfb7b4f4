"""Exact matching of large lexicons: every term is found through one anchor.

An anchor is a run of ``GRAMS`` characters of the term (the whole term if it is
short), the rarest one in a sample of the corpus. Whatever contains a term
contains its anchor, so the different grams, joined with the anchors by
equality, name all candidates, and ``contains`` verifies them.

Texts are cut before grams are taken, so that a candidate costs the length of a
piece and not that of its text (else a long text costs its length squared):

* a term of letters lies inside a run of letters: the pieces are the different
  runs of a text;
* a term of two runs with one space between them lies inside two such runs: the
  pieces are the different pairs of a text, and the anchor of such a term is what
  lies around its space (``EDGE`` characters on each side);
* any other term is verified on the whole text.

Rows are numbered, stored and dealt by blocks of ``BLOCK``. Of a block the
different pieces are looked up once, with a bit for each row that has them, and
different pieces with the same term unite their bits: all inside a task, so that
texts are shuffled once and hits never.

The anchors are broadcast in parts of at most ``PART_TERMS`` terms, so their
size is bounded; a lexicon of more terms takes a pass over the texts for each
part. The sample only decides which gram is the anchor, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.text import search_text
from ..session import spread, stored_once

#: Sizes of anchors; a term takes the largest one that it has characters for.
GRAMS = (6, 3, 2, 1, 0)
PART_TERMS, SAMPLE_TEXTS = 200_000, 5_000
EDGE = 2
BLOCK = 64  # rows of a block: bits of a long
RUN = r"\p{L}+"
#: Characters of a task that cuts texts.
TASK_CHARS = 4 << 20


def gram_size(length: Column) -> Column:
    out = F.lit(0)
    for q in sorted(GRAMS)[1:]:
        out = F.when(length >= q, q).otherwise(out)
    return out


def grams(text: Column, q: int) -> Column:
    """The different runs of q characters of a text (q = 0: the empty one)."""
    if not q:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), 1))


def all_grams(text: Column, sizes: list[int]) -> Column:
    parts = [grams(text, q) for q in sizes]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def terms(K: DataFrame) -> DataFrame:
    """keyword_id, kw (lower case), q of the active terms."""
    act = K.filter(F.coalesce(F.col("active"), F.lit(True))) if "active" in K.columns else K
    kw = F.lower("keyword")
    return act.filter(F.col("keyword").isNotNull()).select("keyword_id", kw.alias("kw"), gram_size(F.length(kw)).alias("q"))


def anchors(t: DataFrame, seen: DataFrame, sizes: list[int], text: str = "text") -> DataFrame:
    """keyword_id, kw, gram: the rarest of the grams of each of ``terms``.

    Frequencies come from the sample ``seen``; grams that it lacks are the
    rarest, and the first by name of equals is taken.
    """
    own = F.array()
    for q in sizes:
        own = F.when(F.col("q") == q, grams(F.col("kw"), q)).otherwise(own)
    mine = t.select("keyword_id", "kw", F.explode(own).alias("gram"))
    held = seen.select(F.explode(all_grams(F.col(text), sizes or [0])).alias("gram"))
    n = held.join(mine.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
    return mine.join(n, "gram", "left").groupBy("keyword_id", "kw").agg(F.min(rank)["gram"].alias("gram"))


def kind(kw: Column) -> Column:
    """What a term's pieces are: word, pair or text."""
    return F.when(kw.rlike(f"^{RUN}$"), "word").when(kw.rlike(f"^{RUN} {RUN}$"), "pair").otherwise("text")


def runs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({RUN})"), 1))


def run_pairs(text: Column) -> Column:
    """The different pairs of neighbouring runs with one space between them."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<!\p{{L}})(?=({RUN}+ {RUN}+))"), 1))


def _sides(pair: Column) -> tuple[Column, Column]:
    return F.substring_index(pair, " ", 1), F.substring_index(pair, " ", -1)


def _edges(left: Column, right: Column, m: Column, n: Column) -> Column:
    return F.concat(F.right(left, m), F.lit(" "), F.left(right, n))


def _pair_anchors(t: DataFrame) -> DataFrame:
    a, b = _sides(F.col("kw"))
    edge = F.lit(EDGE)
    gram = _edges(a, b, F.least(F.length(a), edge), F.least(F.length(b), edge))
    return t.select("keyword_id", "kw", gram.alias("gram")).distinct()


def _piece_grams(cut: DataFrame, what: str, sizes: list[int]) -> DataFrame:
    """``cut`` (piece) with a row for each gram that a term of a piece may have as its anchor."""
    if what == "pair":
        left, right = _sides(F.col("piece"))
        cut = cut.withColumns({"l": left, "r": right}).withColumns({"nl": F.length("l"), "nr": F.length("r")})
        sides = [(m, n) for m in range(1, EDGE + 1) for n in range(1, EDGE + 1)]
        own = [F.when((F.col("nl") >= m) & (F.col("nr") >= n), _edges(F.col("l"), F.col("r"), F.lit(m), F.lit(n))) for m, n in sides]
        return cut.withColumn("gram", F.explode(F.array(*own))).drop("l", "r", "nl", "nr")
    cut = cut.withColumn("n", F.length("piece"))
    at = cut.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n"))))
    own = [F.when(F.col("at") + (q - 1) <= F.col("n"), F.substring("piece", F.col("at"), F.lit(q))) for q in sizes]
    return at.withColumn("gram", F.explode(F.array(*own))).drop("n", "at")


def _in_pieces(rows: DataFrame, found: DataFrame, what: str, sizes: list[int], head: int) -> DataFrame:
    """document_id, keyword_id, top of the terms ``found`` in the pieces of ``rows``.

    Of a block the different pieces are looked up, with a bit for each row that
    has them (``bits``) and has them in its head (``tops``).
    """
    cut = run_pairs if what == "pair" else runs
    bit, zero = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")), F.lit(0).cast("long")
    some = rows.withColumns({"all": cut(F.col("text")), "upper": cut(F.substring("text", 1, head))})
    some = some.select("block", "bit", "upper", F.explode(F.array_union("all", "upper")).alias("piece"))
    whole = some.groupBy("block", "piece").agg(
        F.bit_or(bit).alias("bits"), F.bit_or(F.when(F.array_contains("upper", F.col("piece")), bit).otherwise(zero)).alias("tops"))
    hits = _piece_grams(whole, what, sizes).join(F.broadcast(found), "gram")  # part_terms rows, about
    hits = hits.filter((F.col("gram") == F.col("kw")) | F.col("piece").contains(F.col("kw")))
    hits = hits.groupBy("block", "term").agg(F.bit_or("bits").alias("bits"), F.bit_or("tops").alias("tops"))
    ids = rows.groupBy("block").agg(F.collect_list(F.struct("bit", "document_id")).alias("ids"))  # BLOCK at most
    held = F.filter("ids", lambda x: F.getbit("bits", x["bit"]) == 1)
    hits = hits.join(ids, "block").select("term", "tops", F.explode(held).alias("d"))
    return hits.join(F.broadcast(found.select("term", "keyword_id")), "term").select(
        "d.document_id", "keyword_id", (F.getbit("tops", F.col("d.bit")) == 1).alias("top"))


def _in_texts(rows: DataFrame, found: DataFrame, sizes: list[int], head: int) -> DataFrame:
    """document_id, keyword_id, top of the terms ``found``, verified on whole texts: a text
    holds a gram once and a term has one anchor, so no hit comes twice."""
    cut = rows.select("document_id", "text", F.explode(all_grams(F.col("text"), sizes or [0])).alias("gram"))
    hits = cut.join(F.broadcast(found), "gram")  # part_terms rows, about
    hits = hits.filter((F.col("gram") == F.col("kw")) | F.col("text").contains(F.col("kw")))
    return hits.select("document_id", "keyword_id", F.substring("text", 1, head).contains(F.col("kw")).alias("top"))


def _dealt(d: DataFrame, chars: int) -> DataFrame:
    """Rows dealt by blocks in tasks of about ``TASK_CHARS``. ``d`` is stored: a row's number must not change."""
    tasks = max(d.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))
    block, bit = F.shiftright("row", BLOCK.bit_length() - 1), F.pmod("row", F.lit(BLOCK)).cast("int")
    return d.select(block.alias("block"), bit.alias("bit"), "document_id", "text").repartition(tasks, "block")


def tag_indexed(D: DataFrame, K: DataFrame, head: int = L.EXACT_HEAD_CHARS, cap: int | None = None,
                partitions: int | None = None, part_terms: int = PART_TERMS, sample: int = SAMPLE_TEXTS) -> DataFrame:
    """M1 for lexicons of any size: document_id, keyword_id, match_score,
    match_kind of every term that a text contains, as ``tagging.tag_exact``."""
    d = spread(D, "document_id", partitions).select("document_id", search_text("title", "full_text", cap).alias("text"))
    d = stored_once(d.withColumn("row", F.monotonically_increasing_id()), "texts")
    t = stored_once(terms(K).withColumn("kind", kind(F.col("kw"))), "terms")
    kinds = {r[0] for r in t.select("kind").distinct().collect()}  # three at most
    size = d.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    rows = _dealt(d, size["chars"])
    out = None
    for what in sorted(kinds) or ["text"]:
        mine, sizes = t.filter(F.col("kind") == what), []
        if what == "pair":
            found = _pair_anchors(mine)
        else:
            sizes = sorted(r[0] for r in mine.select("q").distinct().collect())  # GRAMS at most
            some = d.sample(min(1.0, sample / max(1, size["texts"])), 7)
            cut = some.select(F.explode(runs(F.col("text"))).alias("piece")) if what == "word" else some
            found = anchors(mine, cut, sizes, "piece" if what == "word" else "text")
        found = stored_once(found.withColumn("term", F.monotonically_increasing_id()), "anchors")
        parts = max(1, -(-found.count() // part_terms))
        for part in range(parts):
            now = found
            if parts > 1:
                now = found.filter(F.pmod(F.xxhash64("keyword_id", "kw"), F.lit(parts)) == part)
            hits = _in_texts(d, now, sizes, head) if what == "text" else _in_pieces(rows, now, what, sizes, head)
            out = hits if out is None else out.unionByName(hits)
    score = F.when(F.col("top"), F.lit(L.EXACT_HEAD_SCORE)).otherwise(F.lit(L.EXACT_BODY_SCORE))
    return out.select("document_id", "keyword_id", score.alias("match_score"), F.lit("exact").alias("match_kind"))
