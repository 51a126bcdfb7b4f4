"""Operator 7, mixing sources to target weights (DataFrame functions only).

``targets`` shares the whole size among the sources by weight; a source is
read at most ``max_epochs`` times, and what it cannot take is shared anew
among the others until none is above its limit.

``schedule`` is the low-discrepancy order of training blocks. Slot i of the
mix holds one block of ``block`` words; the golden-ratio point
frac((i + 1/2) * phi) falls into one source's interval of the cumulative
weights, which names the source; the slot's rank among that source's slots
names the block. A source's blocks are cut from its shuffled stream: its
documents in the order of a seeded hash, anew for every epoch, with equal
word counts per block. Slots past a source's target are left out, and what
the points leave short (a few blocks by their discrepancy) is appended, so
that each source gives round(target) words exactly.

Running totals and ranks take two levels: totals per bucket (combined before
their shuffle) are summed over buckets, and a window inside one bucket adds
the rest. Buckets are cut by the hash of the row, so a source with a third of
all rows is spread over many tasks.

Every row has its own place in the mix: its key is id, size, digest (of text
and source) and the number among equal rows (``copy``). Rows without an id or
with a repeated one are dealt by the whole key, others by the id alone.

Cases: null source is a source of its own, last in order; null text and null
or repeated ids are rows like any other; texts without words take nothing; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, ceil_div, stored, table

GOLDEN = 0.6180339887498949
#: Words per block, slots per ranking bucket, rows per shuffling bucket.
BLOCK, SLOT_BUCKET, ROW_BUCKET = 256, 16384, 2048


#: What tells rows apart, whatever their ids.
KEY = ["id", "size", "digest", "copy"]


def same_key(a: str, b: str) -> Column:
    return F.expr(" and ".join(f"{a}.{k} <=> {b}.{k}" for k in KEY))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_col: str | None = None) -> DataFrame:
    """row, id, source, size (words of the whole text), digest: the only pass
    over texts. ``row`` numbers the rows unless ``row_col`` does."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_CLASS)), F.lit(0))
                       .cast("long").alias("size"), F.xxhash64(text_col, source_col).alias("digest"))


def numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with shared (the row has no id or a repeated one) and copy."""
    given = sizes.where("id is not null")
    often = given.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("shared"))
    given = given.join(often, "id", "left").select(*sizes.columns, F.coalesce("shared", F.lit(False)).alias("shared"))
    rows = given.unionByName(sizes.where("id is null").withColumn("shared", F.lit(True)))
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "mix-shared")
    many = (rows.where("shared").withColumn("same", F.xxhash64("id", "size", "digest"))
            .withColumn("bucket", F.floor(F.col("place") / ROW_BUCKET)).withColumn("one", F.lit(1)))
    many = _offset(many, ["same"], "bucket", [F.col("place")], "one", "copy")
    return many.select(*rows.columns, F.col("copy").cast("long").alias("copy")).unionByName(
        rows.where("not shared").withColumn("copy", F.lit(0).cast("long")))


def targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """source_no, source, source_size, n_rows, target: one row per source.

    The level that the weights share is found in closed form: with sources in
    the order of limit / weight, the first k at their limits, the level is
    what is left of the total over the weights left; k is the first for which
    the next source stays within its limit.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    one = Window.partitionBy(F.lit(0))
    per = per.withColumn("source_no", F.row_number().over(
        one.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", (F.col("source_no") % 3 + 1).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_epochs)
    order = one.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source_no").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(one))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                         / F.sum("weight").over(after))
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"),
                                               F.struct(F.col("cap") / F.col("weight"), "source_no", "level")))
                         .over(one)["level"])
    return per.select("source_no", "source", "source_size", "n_rows",
                      F.when(F.col("cap") < F.col("level") * F.col("weight"), F.col("cap").cast("double"))
                      .otherwise(F.col("level") * F.col("weight")).alias("target"))


def order_key(id_col: str, epoch: Column, seed: int) -> Column:
    """Place of a row in its source's epoch: 60 bits of an MD5."""
    whole = F.when(F.col("shared"), F.concat_ws(":", F.lit(""), *KEY[1:]))
    salt = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"),
                       F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(whole, F.lit(""))))
    return F.conv(F.substring(F.md5(salt.cast("binary")), 1, 15), 16, 10).cast("long")


def _offset(rows: DataFrame, group: list[str], bucket: str, order: list[Column], value: str,
            out: str) -> DataFrame:
    """Sum of ``value`` over all rows before this one in its group."""
    totals = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_n"))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, bucket, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
            .join(totals, [*group, bucket])
            .withColumn(out, F.col("_before") + F.col("_own")).drop("_before", "_own"))


def streams(sizes: DataFrame, goal: DataFrame, seed: int) -> DataFrame:
    """source_no, epoch, KEY, start: each document of each epoch in the place
    it has in its source's stream, as far as the source's quota goes."""
    goal = goal.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    epochs = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.ceil(F.col("quota") / F.col("source_size")))
                             .otherwise(F.lit(0)).cast("int"))
    epochs = epochs.where("epochs > 0")
    # 2**60 hash values are cut into as many buckets as hold about ROW_BUCKET rows
    rows = (sizes.where("size > 0").alias("s")
            .join(F.broadcast(epochs.alias("e")) if _few(goal) else epochs.alias("e"),
                  F.expr("s.source <=> e.source"))
            .select("e.source_no", "e.source_size", "e.n_rows", "e.quota", "s.shared", *[f"s.{k}" for k in KEY],
                    F.explode(F.sequence(F.lit(0), F.col("e.epochs") - 1)).alias("epoch")))
    rows = rows.withColumn("key", order_key("id", F.col("epoch"), seed))
    width = F.floor(F.lit(2 ** 60) / F.greatest(F.ceil(F.col("n_rows") / ROW_BUCKET), F.lit(1))) + 1
    rows = rows.withColumn("bucket", F.floor(F.col("key") / width))
    rows = _offset(rows, ["source_no", "epoch"], "bucket",
                   [F.col("key"), F.col("id").asc_nulls_last(), *map(F.col, KEY[1:])], "size", "before")
    rows = rows.withColumn("start", F.col("epoch") * F.col("source_size") + F.col("before"))
    return rows.where("start < quota").select("source_no", "epoch", *KEY, "start", "quota")


def _few(goal: DataFrame) -> bool:
    """Whether the table of sources may be broadcast: under 10,000 rows."""
    return len(goal.select("source_no").head(10_000)) < 10_000


def slots(spark: SparkSession, goal: DataFrame, block: int) -> DataFrame:
    """slot, source_no, block_no: the schedule without its words."""
    goal = stored(goal.withColumn("need", F.ceil(F.floor(F.col("target") + 0.5) / block).cast("long")),
                  "mix-goal")
    n = goal.agg(F.sum("need")).first()[0] or 0
    w = Window.partitionBy(F.lit(0)).orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    cut = goal.select("source_no", "need",
                      (F.coalesce(F.sum("need").over(w), F.lit(0)) / F.lit(float(max(n, 1)))).alias("lo"))
    cut = cut.withColumn("hi", F.lead("lo").over(Window.partitionBy(F.lit(0)).orderBy("source_no")))
    cut = cut.withColumn("hi", F.coalesce("hi", F.lit(2.0))).where("need > 0")
    points = spark.range(0, int(n), numPartitions=ceil_div(n, SLOT_BUCKET)).withColumnRenamed("id", "slot")
    u = (F.col("slot") + 0.5) * F.lit(GOLDEN)
    points = points.withColumn("u", u - F.floor(u))
    if _few(goal):
        table_ = cut.agg(F.sort_array(F.collect_list(F.struct("lo", "source_no", "need"))).alias("cuts"))
        named = points.crossJoin(F.broadcast(table_))  # one row: the few sources' intervals
        named = named.withColumn("hit", F.element_at(F.filter("cuts", lambda c: c["lo"] <= F.col("u")), -1))
        named = named.select("slot", "hit.source_no", "hit.need")
    else:  # many sources: match points and intervals by cells of the unit interval
        cells = 1 << 20
        at = cut.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells),
                                                         F.floor(F.least(F.col("hi"), F.lit(0.9999999999)) * cells))))
        named = (points.withColumn("cell", F.floor(F.col("u") * cells)).join(at, "cell")
                 .where("lo <= u and u < hi").select("slot", "source_no", "need"))
    named = named.withColumn("bucket", F.floor(F.col("slot") / SLOT_BUCKET)).withColumn("one", F.lit(1))
    ranked = _offset(named, ["source_no"], "bucket", [F.col("slot")], "one", "block_no")
    ranked = ranked.where("block_no < need").select("slot", "source_no", "block_no")
    have = ranked.groupBy("source_no").agg(F.count("*").alias("have"))
    short = (goal.join(have, "source_no", "left").withColumn("have", F.coalesce("have", F.lit(0)))
             .where("have < need")
             .select("source_no", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("block_no")))
    late = short.select((F.lit(int(n)) + F.col("block_no")).alias("slot"), "source_no", "block_no")
    return ranked.unionByName(late)


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             max_epochs: int = 3, block: int = BLOCK, seed: int = 7, row_col: str | None = None):
    """(sizes, targets, spans). A span says which words of which document a
    slot holds: slot, source_no, block_no, epoch, KEY, first, words. ``sizes``
    has the key of every row."""
    spark = docs.sparkSession
    sizes = stored(numbered(stored(sized(docs, id_col, text_col, source_col, row_col), "mix-rows")), "mix-size")
    goal = stored(targets(sizes, max_epochs), "mix-target")
    rows = streams(sizes, goal, seed)
    end = F.least(F.col("start") + F.col("size"), F.col("quota"))
    parts = rows.withColumn("stop", end).withColumn("block_no", F.explode(
        F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    lo = F.greatest(F.col("start"), F.col("block_no") * block)
    hi = F.least(F.col("stop"), (F.col("block_no") + 1) * block)
    parts = parts.select("source_no", "block_no", "epoch", *KEY,
                         (lo - F.col("start")).alias("first"), (hi - lo).alias("words"))
    return sizes, goal, parts.join(slots(spark, goal, block), ["source_no", "block_no"])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, goal, spans = schedule(table(spark, sf_dir, "documents"))
    taken = spans.groupBy(*KEY).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"),
                                    F.count_distinct("slot").alias("n_slots"))
    rows = sizes.alias("r").join(goal.alias("g"), F.expr("r.source <=> g.source"))
    rows = rows.select("r.*", "g.source_size", "g.target").alias("r").join(taken.alias("t"), same_key("r", "t"), "left")
    return rows.select(F.col("r.id").alias("doc_id"), "r.size", "source_size", "target",
                       F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot",
                       F.coalesce("n_slots", F.lit(0)).alias("n_slots"))


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source,
         length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[^w]', '', 'g'))::BIGINT AS size
  FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
      FROM s GROUP BY source),
q AS (SELECT *, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total,
             row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM p),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
             / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lev FROM q),
m AS (SELECT min_by(lev, k) FILTER (WHERE lev * weight <= cap) AS lev FROM l),
g AS (SELECT source, source_no, source_size, least(cap::DOUBLE, m.lev * weight) AS target,
             floor(least(cap::DOUBLE, m.lev * weight) + 0.5)::BIGINT AS quota FROM q, m),
need AS (SELECT source_no, (quota + 255) // 256 AS need, coalesce(sum((quota + 255) // 256) OVER (
                  ORDER BY source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
                (sum((quota + 255) // 256) OVER ())::BIGINT AS n FROM g),
cuts AS (SELECT source_no, need, before / n::DOUBLE AS lo FROM need WHERE need > 0),
points AS (SELECT slot, x - floor(x) AS u
           FROM (SELECT slot, (slot::DOUBLE + 0.5::DOUBLE) * CAST('0.6180339887498949' AS DOUBLE) AS x
                 FROM (SELECT unnest(range((SELECT max(n) FROM need))) AS slot))),
ranked AS (SELECT source_no, slot, row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS block_no
           FROM points ASOF JOIN cuts ON u >= lo),
slots AS (SELECT b.source_no, b.block_no, coalesce(slot, b.n + b.block_no) AS slot
          FROM (SELECT source_no, n, unnest(range(need)) AS block_no FROM need) b LEFT JOIN ranked USING (source_no, block_no)),
r AS (SELECT s.doc_id, s.size, g.source, g.source_no, g.source_size, g.target, g.quota, e.epoch,
             e.epoch * g.source_size + coalesce(sum(s.size) OVER (
               PARTITION BY g.source, e.epoch
               ORDER BY substr(md5('7:' || e.epoch || ':' || s.doc_id), 1, 15), s.doc_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source
      CROSS JOIN (SELECT unnest([0, 1, 2]) AS epoch) e)
SELECT r.doc_id, size, source_size, target, taken, min(slot) AS first_slot, count(DISTINCT slot) AS n_slots
FROM (SELECT *, greatest(0, least(start + size, quota) - start) AS words,
             sum(greatest(0, least(start + size, quota) - start)) OVER (PARTITION BY doc_id)::BIGINT AS taken,
             unnest(CASE WHEN size > 0 AND start < quota
                         THEN range((start // 256)::BIGINT, ((least(start + size, quota) - 1) // 256 + 1)::BIGINT) ELSE [-1] END) AS block_no
      FROM r) r
LEFT JOIN slots USING (source_no, block_no)
GROUP BY ALL
"""
