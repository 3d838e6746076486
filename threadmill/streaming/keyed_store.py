"""A table by key that micro-batches merge into.

Rows lie in buckets by a hash of their key. A micro-batch writes its own rows as a new version of the buckets that its keys
fall in, one row a key, and leaves the older versions as they are, so what it moves is its own size and not the table's. A bucket's
versions are merged into one when there are ``runs`` of them, and one of ``small`` rows at most is merged at once; then one small
manifest file names the versions of every bucket. Readers follow the latest manifest and merge the versions of a bucket that has
several; they never see half a batch: a batch that dies before its manifest changes nothing, and
a replayed one starts again from the manifest before it. Old versions stay until ``drop_old_versions``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bucket int, version long, rows long, batch long"
#: Versions that a bucket may have beside a new one, and rows of a version that is not worth a file of its own.
RUNS, SMALL = 8, 100
UNKNOWN = 1 << 62  # rows of a version whose manifest does not count them

Merge = Callable[[DataFrame], DataFrame]


def versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, dict[int, int]]:
    """bucket -> rows by version, of the latest manifest (of the latest one before a batch): ``RUNS`` and one versions a bucket at most."""
    try:
        m = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    m = m if before is None else m.where(F.col("batch") < before)
    latest = m.agg(F.max("batch")).first()[0]
    out: dict[int, dict[int, int]] = {}
    for r in [] if latest is None else m.where(F.col("batch") == latest).collect():
        out.setdefault(r["bucket"], {})[r["version"]] = UNKNOWN if r["rows"] is None else r["rows"]
    return out


def _read(spark: SparkSession, path: str, which: dict[int, Iterable[int]]) -> DataFrame | None:
    paths = [f"{path}/data/version={v}/bucket={b}" for b, vs in sorted(which.items()) for v in sorted(vs)]
    return spark.read.option("basePath", f"{path}/data").option("mergeSchema", "true").parquet(*paths).drop("version") if paths else None


def read(spark: SparkSession, path: str, merge: Merge) -> DataFrame:
    """The table as of the latest manifest. ``merge`` gets the rows of the buckets that have several versions and returns one row
    per bucket and key; the other buckets are read as they lie."""
    now = versions(spark, path)
    alone = _read(spark, path, {b: vs for b, vs in now.items() if len(vs) == 1})
    several = _read(spark, path, {b: vs for b, vs in now.items() if len(vs) > 1})
    if alone is None and several is None:
        raise ValueError(f"no batch has been merged into {path}")
    if several is not None:
        merged = merge(several)
        merged = merged.select(*[c for c in several.columns if c in merged.columns])
        alone = merged if alone is None else alone.unionByName(merged, allowMissingColumns=True)
    return alone.drop("bucket")


def _write_manifest(spark: SparkSession, path: str, batch_id: int, now: dict[int, dict[int, int]]) -> None:
    rows = spark.createDataFrame([(b, v, n) for b, vs in sorted(now.items()) for v, n in sorted(vs.items())], "bucket int, version long, rows long")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch_id}")  # one file: there or not


def _write(rows: DataFrame, path: str, version: int, merge: Merge) -> dict[int, int]:
    """Write the merged rows as a version, in one shuffle; rows by bucket (from the files' footers)."""
    at = f"{path}/data/version={version}"
    merge(rows.repartition("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(at)
    written = rows.sparkSession.read.schema("bucket int").parquet(at)
    return {r["bucket"]: r["count"] for r in written.groupBy("bucket").count().collect()}


def merge_batch(batch: DataFrame, batch_id: int, path: str, key: str, merge: Merge, buckets: int, runs: int = RUNS, small: int = SMALL) -> None:
    """Merge a micro-batch. ``merge`` gets rows with the column ``bucket`` and returns one row per bucket and key; it may see the
    rows of a key in several turns."""
    spark = batch.sparkSession
    now = versions(spark, path, before=batch_id)
    fresh = _write(batch.withColumn("bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")), path, batch_id, merge)
    again: dict[int, list[int]] = {}
    for b, n in fresh.items():
        past = now.setdefault(b, {})
        old = [v for v, rows in past.items() if rows <= small or len(past) >= runs]
        if old:
            again[b] = [*old, batch_id]
        past[batch_id] = n
    if again:
        folded = -1 - batch_id  # a number that no batch has
        for b, n in _write(_read(spark, path, again), path, folded, merge).items():
            now[b] = {v: rows for v, rows in now[b].items() if v not in again[b]} | {folded: n}
    if now:
        _write_manifest(spark, path, batch_id, now)


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete the bucket versions that the latest manifest does not name (no reader
    may be on an older one); their number."""
    kept = {f"version={v}/bucket={b}" for b, vs in versions(spark, path).items() for v in vs}
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for version in files.listStatus(root):
        for bucket in files.listStatus(version.getPath()):
            name = f"{version.getPath().getName()}/{bucket.getPath().getName()}"
            if "bucket=" in name and name not in kept:
                files.delete(bucket.getPath(), True)
                gone += 1
    return gone
