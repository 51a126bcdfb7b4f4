"""Table-level sources: dimension seeding, manual appends, incremental
reads (S9, S10, S11, S12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import as_of_ts
from ..operators import ranks


def load_lexicon(spark: SparkSession, sections: dict[str, list[dict]], levels: dict[str, int],
                 existing: DataFrame | None = None) -> DataFrame:
    """Config sections -> keyword rows; insert only (keyword, level)
    pairs not present yet. ``sections``: {section: [{keyword, cluster, ...}]}."""
    rows = [(e["keyword"], int(levels[sec]), e.get("cluster"), e.get("disease_area"),
             e.get("geography_tag"), True)
            for sec, items in sections.items() for e in items]
    new = spark.createDataFrame(rows, "keyword string, level int, cluster string, disease_area string, "
                                      "geography_tag string, active boolean").dropDuplicates(["keyword", "level"])
    if existing is not None:
        new = new.join(existing.select("keyword", "level"), ["keyword", "level"], "left_anti")
    return new


def load_sources(spark: SparkSession, entries: list[dict], existing: DataFrame | None = None) -> DataFrame:
    """Source catalogue entries -> source rows with their defaults; the
    first entry of a name counts, names that are stored already do not."""
    seen: dict[str, tuple] = {}
    for e in entries:
        seen.setdefault(e["name"], (e["name"], e["source_type"], e.get("country"), e.get("region"), e.get("url"),
                                    e.get("access_method"), int(e.get("refresh_hours", 24)),
                                    int(e.get("trust_level", 3)), True))
    new = spark.createDataFrame(list(seen.values()), "source_name string, source_type string, country string, "
                                "region string, url string, access_method string, refresh_hours int, "
                                "trust_level int, active boolean")
    return new if existing is None else new.join(existing.select("source_name"), "source_name", "left_anti")


def with_source_ids(rows: DataFrame, sources: DataFrame, name: str = "source_name") -> tuple[DataFrame, DataFrame]:
    """(rows with the id of their source, sources with the new ones).

    Names that are not stored get the next ids in the order of their names.
    """
    top = sources.agg(F.coalesce(F.max("source_id"), F.lit(0)).alias("_top"))
    new = rows.select(name).where(F.col(name).isNotNull()).distinct().join(sources.select(name), name, "left_anti")
    new = ranks.place(new, [F.col(name)], "_place").crossJoin(F.broadcast(top)).select(  # one row
        name, (F.col("_top") + F.col("_place")).cast("int").alias("source_id"))
    every = sources.unionByName(new, allowMissingColumns=True)
    return rows.join(every.select(name, "source_id"), name, "left"), every


def append_absent(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are not yet stored, each once; ``rows`` holds key columns
    only or rows that do not differ within a key."""
    return rows.dropDuplicates(key).join(target.select(*key).distinct(), key, "left_anti")


def since(df: DataFrame, marks: DataFrame, key: str, ts_col: str, as_of: str, days: int = 30) -> DataFrame:
    """Rows at or after the source's high-water mark, else a lookback
    window. ``marks``: (source, mark)."""
    j = df.join(marks, key, "left")
    lo = F.coalesce(F.col("mark"), as_of_ts(as_of) - F.make_dt_interval(F.lit(days)))
    return j.filter(F.col(ts_col) >= lo).drop("mark")


def high_water_marks(df: DataFrame, key: str, ts_col: str) -> DataFrame:
    """K8: new high-water mark per source."""
    return df.groupBy(key).agg(F.max(ts_col).alias("mark"))
