"""Keyed tables as hash-bucketed Parquet under a manifest.

A key lies in the bucket that its hash names. A commit writes only the buckets
that hold keys of the batch, each into the folder of the commit's version, and
then one small manifest that names the folders of every bucket; the manifest
is written beside its place and moved there, so a commit counts whole or not
at all. Files of untouched buckets stay as they are. Readers take the newest
manifest, or that of a given version, and may ask for some buckets only.

Versions are numbers that the caller may give (the epoch of a stream): a
repeated epoch starts from the newest version before it and replaces what its
first try left, so it counts once. ``vacuum`` removes folders that none of
the last manifests name.

Everything passes through Spark and the Hadoop file system; the driver sees
bucket numbers and manifests only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def newest(keys: list[str], order: str) -> Merge:
    """Of all rows of a key, stored or new, the one with the largest order
    value stays (of equal ones the new row)."""
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        cols = old.columns
        rows = old.withColumn("_new", F.lit(0)).unionByName(new.select(*cols).withColumn("_new", F.lit(1)))
        best = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
            F.max(F.struct(F.col(order).alias("_o"), "_new", *[c for c in cols if c != order])).alias("_row"))
        return best.select(*[F.col("_row._o").alias(c) if c == order else F.col(f"_row.{c}").alias(c) for c in cols])
    return merge


def combined(keys: list[str], **how) -> Merge:
    """One row per key: the other columns of stored and new rows aggregated."""
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.unionByName(new.select(*old.columns))
        return rows.groupBy(*keys).agg(*[f(c).alias(c) for c, f in how.items()]).select(*old.columns)
    return merge


class BucketTable:
    """A table of rows with keys; ``by`` are the key columns that name the bucket."""

    def __init__(self, spark: SparkSession, path: str, by: list[str], buckets: int = 32):
        self.spark, self.path, self.by, self.buckets = spark, path.rstrip("/"), by, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------ manifests --
    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def _names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        """Versions that count, oldest first."""
        return [int(n[1:-5]) for n in self._names("manifest") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """{"schema", "buckets": {bucket: [folders]}} of a version, the newest by default."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            return {"schema": None, "buckets": {}}
        text = self.spark.read.text(str(self._at("manifest", f"v{known[-1]:012d}.json")), wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, version: int, manifest: dict) -> None:
        target = self._at("manifest", f"v{version:012d}.json")
        draft = self._at("manifest", f".{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        if self._fs.exists(target):  # a repeated commit of the same version
            self._fs.delete(target, False)
        if not self._fs.rename(draft, target):
            raise OSError(f"manifest {target} could not be published")

    # ----------------------------------------------------------------- read --
    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows (of some buckets); None before the first commit."""
        return self._rows(self.manifest(version), buckets)

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.path}/data/{folder}" for b, folders in sorted(manifest["buckets"].items())
                 if wanted is None or b in wanted for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys: ``buckets`` numbers at most."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    # --------------------------------------------------------------- commit --
    def commit(self, rows: DataFrame, merge: Merge | None = None, version: int | None = None) -> int:
        """Merge rows into the buckets of their keys (without ``merge``: add
        them as a further folder of each bucket). Returns the version."""
        known = self.versions()
        version = (known[-1] + 1 if known else 0) if version is None else version
        before = self.manifest(version - 1) if version else {"schema": None, "buckets": {}}
        hit = self.touched(rows)
        new = rows
        if merge is not None:
            old = self._rows(before, hit)
            new = merge(self.spark.createDataFrame([], rows.schema) if old is None else old, rows)
        schema = json.loads(rows.schema.json()) if before["schema"] is None else before["schema"]
        names = [f["name"] for f in schema["fields"]]
        folder = f"v{version:012d}-{uuid.uuid4().hex[:8]}"
        out = new.select(*names, self.bucket().alias("_bucket"))
        out.repartition(max(1, len(hit)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        written = {n.removeprefix("_bucket=") for n in self._names("data", folder) if n.startswith("_bucket=")}
        table = dict(before["buckets"])
        for b in map(str, hit):
            kept = table.pop(b, []) if merge is None else []
            table.pop(b, None)
            if b in written or kept:
                table[b] = kept + ([f"{folder}/_bucket={b}"] if b in written else [])
        self._publish(version, {"schema": schema, "buckets": table})
        return version

    def compact(self, folders: int = 8) -> int | None:
        """Rewrite buckets of more than ``folders`` folders into one each."""
        now = self.manifest()
        many = [int(b) for b, f in now["buckets"].items() if len(f) > folders]
        return self.commit(self._rows(now, many), merge=lambda old, new: new) if many else None

    def vacuum(self, keep: int = 2) -> None:
        """Remove manifests but the last ``keep`` and folders that none of them names."""
        versions = self.versions()
        for v in versions[:-keep] if keep else []:
            self._fs.delete(self._at("manifest", f"v{v:012d}.json"), False)
        named = {f for v in self.versions() for fs in self.manifest(v)["buckets"].values() for f in fs}
        oldest = f"v{versions[-1] + 1:012d}" if versions else ""
        for folder in self._names("data"):
            for part in self._names("data", folder):
                if part.startswith("_bucket=") and f"{folder}/{part}" not in named and folder < oldest:
                    self._fs.delete(self._at("data", folder, part), True)


class SeenKeys:
    """All keys that ever came, with a Bloom filter per bucket.

    Filters are rows (bucket, word, bits) of a bucketed table of their own: a
    key sets ``PROBES`` bits among its bucket's 64 * ``words``. A batch joins the
    filter rows of its keys, and only buckets for which some key passes are
    read, so a batch of new keys reads filter rows in place of the history.
    """

    PROBES = 3

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 32, words: int = 1 << 14):
        self.key, self.words = key, words
        self.keys = BucketTable(spark, f"{path}/keys", key, buckets)
        self.filters = BucketTable(spark, f"{path}/filters", ["bucket"], buckets)

    def _bits(self, rows: DataFrame) -> DataFrame:
        """The keys (as _k0, _k1, ...) with bucket, word and bit of each probe."""
        probes = F.array(*[F.xxhash64(F.lit(k), *self.key) for k in range(self.PROBES)])
        names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)]
        at = rows.select(*names, self.keys.bucket().alias("bucket"), F.explode(probes).alias("_probe"))
        return at.select(*[f"_k{i}" for i in range(len(self.key))], "bucket",
                         F.pmod(F.shiftright("_probe", 6), F.lit(self.words)).cast("int").alias("word"),
                         F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_probe").bitwiseAND(63).cast("int")).alias("bit"))

    def suspects(self, batch: DataFrame, version: int | None = None) -> list[int]:
        """Buckets that may hold a key of the batch, by the filters alone."""
        hit = self.keys.touched(batch)
        filters = self.filters.read(version, self._filter_buckets(hit))
        if filters is None:
            return []
        probes = self._bits(batch.select(*self.key).distinct())
        passed = probes.join(filters, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        full = passed.groupBy("bucket", *[f"_k{i}" for i in range(len(self.key))]).agg(F.count("*").alias("n"))
        full = full.where(F.col("n") == self.PROBES)
        return sorted(r[0] for r in full.select("bucket").distinct().collect())  # bucket numbers

    def _filter_buckets(self, hit: list[int]) -> list[int]:
        if not hit:
            return []
        spark = self.filters.spark
        return self.filters.touched(spark.createDataFrame([(b,) for b in hit], "bucket int"))

    def unseen(self, batch: DataFrame, version: int | None = None) -> DataFrame:
        """The batch's rows whose key has not come before (``version``: up to it)."""
        held = self.keys.read(version, self.suspects(batch, version))
        if held is None:
            return batch
        held = held.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(self.key)])
        same = F.lit(True)
        for i, k in enumerate(self.key):
            same = same & F.col(k).eqNullSafe(F.col(f"_h{i}"))
        return batch.join(held, same, "left_anti")

    def add(self, fresh: DataFrame, version: int | None = None) -> None:
        """Add different keys that have not come before: their buckets get a
        further folder, their filter rows new bits."""
        keys = fresh.select(*self.key)
        bits = self._bits(keys).groupBy("bucket", "word").agg(F.bit_or("bit").alias("bits"))
        self.filters.commit(bits, combined(["bucket", "word"], bits=F.bit_or), version)
        self.keys.commit(keys, None, version)
