"""Operator 6, chat formatting by cumulative-snapshot collapse (DataFrame
functions only).

A log often holds a conversation many times: each call stores all turns so
far. Each turn gets the hash of the prefix that it ends; a conversation whose
whole-conversation hash occurs as a shorter prefix of another one is a
snapshot, and an anti join leaves the maximal conversations, which are then
rendered.

The prefix hash is a running sum of turn hashes salted with the turn's place
(four 32-bit sums of two 64-bit hashes: 128 bits), so it needs no sequential
state: totals per run of ``CHUNK`` turn numbers are summed over chunks and a
window inside a chunk adds the rest. A conversation with a third of all rows
is spread over its chunks, and its rendering over parts of ``CHUNK`` turns.

Cases: exact repeats of a row count once; turns with the same number are
ordered by role, then text; a null turn comes first; null role and text count
as empty; a row without conversation id belongs to conversation null; equal
conversations keep the smallest id; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

CHUNK = 1024
_SUMS = ["s0", "s1", "s2", "s3"]


def prefixes(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, place (1..), role, text and the prefix hash s0..s3."""
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.dropDuplicates(["conv", "turn", "role", "text"])
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    own = Window.partitionBy("conv", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    over = Window.partitionBy("conv").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv", "chunk").count()
    counts = counts.select("conv", "chunk", F.coalesce(F.sum("count").over(over), F.lit(0)).alias("before"))
    same = "r.conv <=> c.conv and r.chunk <=> c.chunk"
    placed = (rows.withColumn("rank", F.row_number().over(own)).alias("r")
              .join(counts.alias("c"), F.expr(same))
              .select("r.*", (F.col("c.before") + F.col("rank")).alias("place")))
    h0 = F.xxhash64("place", "role", "text")
    h1 = F.xxhash64(F.lit("second"), "text", "role", "place")
    low = F.lit(0xFFFFFFFF).cast("long")
    placed = placed.withColumn("h0", h0).withColumn("h1", h1).select(
        "conv", "chunk", "place", "role", "text",
        F.col("h0").bitwiseAND(low).alias("s0"), F.shiftrightunsigned("h0", 32).alias("s1"),
        F.col("h1").bitwiseAND(low).alias("s2"), F.shiftrightunsigned("h1", 32).alias("s3"))
    placed = stored(placed, "chat-turns")
    totals = placed.groupBy("conv", "chunk").agg(*[F.sum(s).alias(s) for s in _SUMS])
    totals = totals.select("conv", "chunk", *[F.coalesce(F.sum(s).over(over), F.lit(0)).alias("b" + s) for s in _SUMS])
    run = Window.partitionBy("conv", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    within = placed.select("conv", "chunk", "place", "role", "text", *[F.sum(s).over(run).alias(s) for s in _SUMS])
    return (within.alias("r").join(totals.alias("c"), F.expr(same))
            .select("r.conv", "r.place", "r.role", "r.text",
                    *[(F.col("r." + s) + F.col("c.b" + s)).alias(s) for s in _SUMS]))


def maximal(pre: DataFrame) -> DataFrame:
    """conv, n_turns, n_copies of conversations that no longer one extends."""
    keys = pre.select("conv", "place", *_SUMS)
    ends = keys.groupBy("conv").agg(F.max("place").alias("n_turns"))
    ended = keys.alias("k").join(ends.alias("e"), F.expr("k.conv <=> e.conv"))
    finals = (ended.where("k.place = e.n_turns").groupBy("place", *_SUMS)
              .agg(F.min("k.conv").alias("conv"), F.count("*").alias("n_copies")))
    inner = ended.where("k.place < e.n_turns").select("place", *_SUMS).distinct()
    return finals.join(inner, ["place", *_SUMS], "left_anti").select(
        "conv", F.col("place").alias("n_turns"), "n_copies")


def render(pre: DataFrame, kept: DataFrame) -> DataFrame:
    """conv, part, n_turns, n_copies, rendered: CHUNK turns a part."""
    turns = (pre.alias("p").join(kept.alias("k"), F.expr("p.conv <=> k.conv"))
             .select("k.conv", "k.n_turns", "k.n_copies", "p.place",
                     F.concat(F.lit("<|im_start|>"), F.col("p.role"), F.lit("\n"), F.col("p.text"),
                              F.lit("<|im_end|>\n")).alias("line"),
                     F.floor((F.col("p.place") - 1) / CHUNK).alias("part")))
    return (turns.groupBy("conv", "part", "n_turns", "n_copies")
            .agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
            .select("conv", "part", "n_turns", "n_copies",
                    F.concat_ws("", F.transform("lines", lambda x: x["line"])).alias("rendered")))


def chat_format(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    pre = stored(prefixes(turns, conv, turn, role, text), "chat-prefix")
    return render(pre, stored(maximal(pre), "chat-maximal"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, part, n_turns, n_copies, rendered of every maximal conversation."""
    return chat_format(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT conv_id, row_number() OVER w AS place,
             '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line,
             md5(string_agg(md5(role) || md5(text), '') OVER (w ROWS UNBOUNDED PRECEDING)) AS h
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT conv_id, max(place) AS n_turns, max_by(h, place) AS h FROM r GROUP BY conv_id),
f AS (SELECT min(conv_id) AS conv_id, n_turns, h, count(*) AS n_copies FROM e GROUP BY n_turns, h),
k AS (SELECT f.* FROM f WHERE NOT EXISTS (
        SELECT 1 FROM r JOIN e USING (conv_id)
        WHERE r.place = f.n_turns AND r.h = f.h AND e.n_turns > f.n_turns))
SELECT r.conv_id, (r.place - 1) // 1024 AS part, k.n_turns, k.n_copies,
       string_agg(r.line, '' ORDER BY r.place) AS rendered
FROM r JOIN k USING (conv_id) GROUP BY ALL
"""
