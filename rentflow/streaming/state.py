"""The listings' state as a table in hash buckets, which a micro-batch rewrites only where it touches it.

Layout under one folder: ``state/version=V/bucket=B`` holds the rows of a bucket as version V left them, ``prices/version=V`` the
price log of V, ``new/version=V`` the keys that V saw first, ``manifest/version=V`` for each bucket the version that wrote it
last. The manifest is written after all else and is what makes a version: files of a version without one are not read,
and the batch that is run again overwrites them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile


class StateTable:
    """``keys`` name a row, ``tracked`` are compared; ``buckets`` is fixed for the life of a table."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], tracked: dict[str, str], key_types: dict[str, str] | None = None, buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.tracked, self.buckets = spark, path.rstrip("/"), keys, tracked, buckets
        kinds = {k: (key_types or {}).get(k, "string") for k in keys}
        self.shape = kinds | {"status": "string", "miss_count": "int", "first_seen_at": "timestamp", "last_seen_at": "timestamp", "delisted_at": "timestamp"} | tracked
        self.schema = ", ".join(f"{c} {kind}" for c, kind in self.shape.items())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _versions(self) -> list[int]:
        """Complete versions: those whose manifest has been committed."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        found = [str(s.getPath().getName()) for s in files.listStatus(where)]
        return sorted(int(n.removeprefix("version=")) for n in found if n.startswith("version=") and self._exists(f"{self.path}/manifest/{n}/_SUCCESS"))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The version of each bucket that has rows, as of the newest version (below ``before``)."""
        known = [v for v in self._versions() if before is None or v < before]
        if not known:
            return {}
        rows = self.spark.read.schema("bucket int, written long").parquet(f"{self.path}/manifest/version={known[-1]}").collect()  # one row a bucket
        return {r.bucket: r.written for r in rows}

    def rows(self, manifest: dict[int, int] | None = None) -> DataFrame:
        """The state as of a manifest (the newest)."""
        where = self.manifest() if manifest is None else manifest
        if not where:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/state/version={v}/bucket={b}" for b, v in sorted(where.items())])

    def _all(self, name: str, schema: str) -> DataFrame:
        paths = [p for v in self._versions() if self._exists(p := f"{self.path}/{name}/version={v}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def prices(self) -> DataFrame:
        """(keys, seen_at, price_pcm): first prices and every change, also inside a batch."""
        return self._all("prices", ", ".join([*(f"{k} {self.shape[k]}" for k in self.keys), "seen_at timestamp", f"price_pcm {self.tracked['price_pcm']}"]))

    def new(self) -> DataFrame:
        """(keys, version) of rows seen for the first time."""
        return self._all("new", ", ".join([*(f"{k} {self.shape[k]}" for k in self.keys), "version long"]))

    def apply(self, batch: DataFrame, version: int, mode: str = "hot", health: Column | None = None, scope: Column | None = None) -> None:
        """Version ``version`` from the sightings of ``batch`` (keys, tracked, seen_at). Running it again gives the same tables.

        A hot batch touches the buckets of its keys. A sweep touches all buckets that have rows, as absence counts; ``scope``,
        over the stored rows, names those that the sweep looked at (the others are held). ``health`` as in ``reconcile``.
        """
        keys, tracked = self.keys, list(self.tracked)
        seen = batch.select(*keys, *tracked, "seen_at")
        newest = reconcile.latest(seen, keys, ["seen_at"])
        before = self.manifest(version)
        touched = {r[0] for r in newest.select(self.bucket()).distinct().collect()}  # no more than there are buckets
        if mode == "sweep":
            touched |= set(before)
        old = self.rows({b: v for b, v in before.items() if b in touched})
        now = F.lit(seen.agg(F.max("seen_at")).first()[0]).cast("timestamp")
        healthy = F.lit("ok") if health is None else health
        if scope is not None:
            healthy = F.when(scope, healthy).otherwise("out of scope")
        decided = reconcile.reconcile(old, newest.select(*keys, *tracked), keys, tracked, mode, healthy)
        at = newest.select(*keys, F.col("seen_at").alias("__at"))
        decided = reconcile.stamped(decided.join(at, keys, "left"), old, keys, F.coalesce("__at", now))
        home = f"{self.path}/state/version={version}"
        rows = decided.select(*self.shape, "kind", self.bucket().alias("bucket"))
        rows.repartition(max(1, min(self.buckets, len(touched))), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(home)

        # The log and the new keys are read from what was just written, so they can't differ from it.
        written = self.spark.read.schema(f"{self.schema}, kind string, bucket int").option("basePath", home).parquet(home) if touched else None
        if written is not None:
            first = written.where(F.col("kind") == "insert").select(*keys)
            if "price_pcm" in self.tracked:
                opened = seen.where(F.col("price_pcm").isNotNull()).join(old.where(F.col("price_pcm").isNotNull()).select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min_by(F.struct("seen_at", "price_pcm"), "seen_at").alias("r")).select(*keys, "r.*")
                moved = reconcile.batch_changes(seen, old, keys, ["seen_at"]).select(*keys, "seen_at", F.col("new").alias("price_pcm"))
                opened.unionByName(moved).coalesce(max(1, len(touched) // 8)).write.mode("overwrite").parquet(f"{self.path}/prices/version={version}")
            first.withColumn("version", F.lit(version).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/new/version={version}")
        after = before | {b: version for b in touched}
        self.spark.createDataFrame(sorted(after.items()), "bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")


def observe(sightings: DataFrame, state_path: str, checkpoint: str, keys: list[str], tracked: list[str], mode: str = "hot", buckets: int = 64):
    """Reconciles every micro-batch with a StateTable and starts the query (available data, then it ends). A batch that is run
    again after a crash gives the same version. Files of old versions are the caller's to remove."""
    kinds = dict(sightings.dtypes)
    state = StateTable(sightings.sparkSession, state_path, keys, {c: kinds[c] for c in tracked}, {k: kinds[k] for k in keys}, buckets)

    def step(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # read several times
        state.apply(held, number, mode)
        held.unpersist()

    return sightings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
