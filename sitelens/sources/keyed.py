"""A keyed table of hash buckets: a batch rewrites only the buckets it touches.

Parquet has no row-level update.  Here a row lives in the bucket that the hash
of its key names, every bucket is one folder, and a write makes new folders
for the touched buckets only:

    <path>/layout                         an empty file: the columns
    <path>/data/_at=<version>/_bucket=<b> rows of bucket b as of a version
    <path>/versions/version=<n>           one row per bucket: (bucket, at)

A version is committed by its ``versions`` file, which is written last and
appears at once, so readers see a whole version or the one before.  A write that is
run again under the same version reads the version before it and replaces its
own folders: a retry or a replayed micro-batch leaves no duplicates.  A table
has one writer at a time.

What grows with what: a write reads and writes the touched buckets (at most
as many as the batch has keys) and one row per bucket of bookkeeping, whatever
the number of earlier writes; only the numbers of touched buckets reach the
driver.  Buckets should be a few row groups each: choose ``buckets`` as table
size / 128 MB.

Defined results: null keys are keys like any other (one row per null key); an
empty batch commits a version without new folders; batch columns that the table
does not have are not stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import materialize
from sitelens.sources.store import latest_by_key

#: Versions that stay readable (a replayed batch needs the one before it).
KEEP_VERSIONS = 3


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


class KeyedTable:
    """The table at ``path`` with one row per ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str], buckets: int = 64) -> KeyedTable:
        """A table that holds ``rows`` (a key once) as its version 0."""
        table = cls(rows.sparkSession, path, key)
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{table.path}/layout")
        new = materialize(rows.withColumn("_bucket", _bucket(key, buckets)), "keyed-rows")
        live = dict.fromkeys(range(buckets))
        filled = table._touched(new, live)
        if filled:
            table._write(new.repartition("_bucket"), 0)
        table._commit(0, {**live, **dict.fromkeys(filled, 0)})
        return table

    def exists(self) -> bool:
        fs, target = _file_system(self.spark, f"{self.path}/versions")
        return fs.exists(target) and bool(self.versions())

    def versions(self) -> list[int]:
        """The committed versions that are still readable, ascending."""
        fs, target = _file_system(self.spark, f"{self.path}/versions")
        found = [f.getPath() for f in fs.listStatus(target)]
        done = [p for p in found if any(g.getPath().getName().endswith(".parquet") for g in fs.listStatus(p))]
        return sorted(int(p.getName().partition("=")[2]) for p in done)

    def _version(self, before: int | None) -> int:
        """The newest version, or the newest one below ``before``."""
        found = [v for v in self.versions() if before is None or v < before]
        if not found:
            raise ValueError(f"{self.path}: no version below {before} is kept")
        return found[-1]

    def live(self, version: int) -> dict[int, int | None]:
        """Bucket -> version of its folder (None: no rows yet)."""
        rows = self.spark.read.parquet(f"{self.path}/versions/version={version}").collect()
        return {r.bucket: r["at"] for r in rows}

    def _layout(self):
        return self.spark.read.parquet(f"{self.path}/layout").schema

    def _in_stored_types(self, rows: DataFrame) -> DataFrame:
        """The columns the table has, with its types (a hash depends on them)."""
        known = [f for f in self._layout().fields if f.name in rows.columns]
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known])

    def _rows(self, live: dict[int, int | None]) -> DataFrame:
        """(columns, bucket) of some buckets; no other file is opened."""
        schema = self._layout()
        folders = [f"{self.path}/data/_at={at}/_bucket={b}" for b, at in sorted(live.items()) if at is not None]
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("_bucket", F.lit(0))
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders)
        return rows.select(*schema.names, F.col("_bucket").cast("int").alias("_bucket"))

    def _touched(self, keyed: DataFrame, live: dict[int, int | None]) -> dict[int, int | None]:
        """The buckets of the rows (numbers below the number of buckets)."""
        found = keyed.select(_bucket(self.key, len(live)).alias("b")).distinct().collect()
        return {r.b: live[r.b] for r in found}

    def read(self, before: int | None = None) -> DataFrame:
        """All rows of the newest version (below ``before``)."""
        return self._rows(self.live(self._version(before))).drop("_bucket")

    def read_near(self, keyed: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of the buckets that may hold the keys of ``keyed`` (a
        join with its key columns follows)."""
        live = self.live(self._version(before))
        return self._rows(self._touched(self._in_stored_types(keyed), live)).drop("_bucket")

    def upsert(
        self, batch: DataFrame, order: list[str] | None = None, mutable: list[str] | None = None,
        newest: bool = False, version: int | None = None,
    ) -> int:
        """``batch`` rows update the stored row of their key field by field, or
        are inserted; returns the version made.

        Of several batch rows with one key the largest by ``order`` counts (a
        batch without ``order`` must hold a key once).  An update sets the
        ``mutable`` columns the batch has (default: all of them; none with an
        empty list, which is insert-or-ignore).  With ``newest`` the ``order``
        columns are stored ones and a stored row that is larger by them stays as it
        is.  ``version`` is the number a replayed batch is known by.
        """
        last = self._version(version)
        version = last + 1 if version is None else version
        live = self.live(last)
        if order:
            batch = latest_by_key(batch.withColumn("_order", F.struct(*order)), self.key, "_order").drop("_order")
        new = materialize(self._in_stored_types(batch), "keyed-batch")
        touched = self._touched(new, live)
        if touched:
            self._write(self._merged(self._rows(touched), new, len(live), order if newest else None, mutable), version)
        self._commit(version, {**live, **dict.fromkeys(touched, version)})
        self._forget(version)
        return version

    def _merged(self, old: DataFrame, new: DataFrame, buckets: int, order: list[str] | None, mutable: list[str] | None) -> DataFrame:
        """Old and new rows side by side after one exchange, by bucket; the
        rows of a bucket are written where they were merged."""
        key = self.key
        others = [c for c in old.columns if c not in key and c != "_bucket"]
        given = [c for c in others if c in new.columns]
        n = new.select(
            _bucket(key, buckets).alias("_bucket"), *key, F.struct(F.lit(True).alias("_in"), *given).alias("n")
        )
        o = old.select("_bucket", *key, F.struct(F.lit(True).alias("_in"), *others).alias("o"))
        pairs = o.unionByName(n, allowMissingColumns=True).repartition("_bucket").groupBy("_bucket", *key).agg(
            F.first("o", ignorenulls=True).alias("o"), F.first("n", ignorenulls=True).alias("n")
        )
        held, sets = F.col("o._in").isNotNull(), F.col("n._in").isNotNull()
        if order:
            sets &= ~held | (F.struct(*[F.col(f"n.{c}") for c in order]) >= F.struct(*[F.col(f"o.{c}") for c in order]))
        settable = given if mutable is None else [c for c in given if c in mutable]

        def value(c: str) -> Column:
            if c in settable:
                return F.when(sets, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
            if c in given:
                return F.when(held, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
            return F.col(f"o.{c}")

        return pairs.select(*[F.col(c) if c in key or c == "_bucket" else value(c).alias(c) for c in old.columns])

    def _write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/_at={version}")

    def _commit(self, version: int, live: dict[int, int | None]) -> None:
        rows = self.spark.createDataFrame(sorted(live.items()), "bucket int, at long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")

    def _forget(self, version: int) -> None:
        """Drop versions older than the kept ones, and the folders that only
        they name (no more than their writes made)."""
        found = [v for v in self.versions() if v <= version]
        kept = found[-KEEP_VERSIONS:]
        used = {(b, at) for v in kept for b, at in self.live(v).items()}
        for old in found[:-KEEP_VERSIONS]:
            for b, at in self.live(old).items():
                if at is not None and (b, at) not in used:
                    self._delete(f"data/_at={at}/_bucket={b}")
            self._delete(f"versions/version={old}")

    def _delete(self, name: str) -> None:
        fs, target = _file_system(self.spark, f"{self.path}/{name}")
        fs.delete(target, True)

    def rewritten(self, version: int) -> list[int]:
        """The buckets that a version wrote."""
        return sorted(b for b, at in self.live(version).items() if at == version)
