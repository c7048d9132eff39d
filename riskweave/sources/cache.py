"""The series cache: versions that share unchanged months, a hash tree by series and month, and what decides whether it
serves."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import written


def content_hash(series: DataFrame) -> DataFrame:
    """(series_id, sha256) of the rows rendered as CSV lines `date,value` in date order, values with 12 significant
    digits and missing ones empty."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        digest = hashlib.sha256()
        for day, v in sorted(zip(pdf["date"].astype(str), pdf["value"])):
            digest.update(f"{day},{'' if v is None or v != v else f'{v:.12g}'}\n".encode())
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "content_hash": [digest.hexdigest()]})

    return series.select("series_id", "date", "value").groupBy("series_id").applyInPandas(run, "series_id string, content_hash string")


def fingerprint(kind: str, series_id: str, lag_days: int, frequency: str) -> str:
    return hashlib.sha256(f"{kind}|{series_id}|{lag_days}|{frequency}".encode()).hexdigest()


# --- versions ------------------------------------------------------------------------------------------------
#
# path/data/version=V/series_id=S    the months of series that version V changed
# path/manifest/V                    for every month of every series its hash and the version that has its rows
# path/versions/V                    an empty file, made last: the version counts from then on


def leaves(series: DataFrame) -> DataFrame:
    """(series_id, month, leaf, n, start, last): the leaves of the hash tree, of a month's lines in order with 12
    significant digits, missing values empty."""
    value = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.format_string("%.11e", "value")).otherwise("")
    line = F.concat(F.col("date").cast("string"), F.lit(","), value)
    digest = F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))).cast("binary"), 256)
    return series.groupBy("series_id", F.trunc("date", "MM").alias("month")).agg(digest.alias("leaf"), F.count("*").alias("n"), F.min("date").alias("start"), F.max("date").alias("last"))


def roots(entries: DataFrame) -> DataFrame:
    """A row a series: span, count, and as content_hash the root of its tree."""
    root = F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat(F.col("month").cast("string"), F.lit(","), F.col("leaf"))))).cast("binary"), 256)
    return entries.groupBy("series_id").agg(F.min("start").alias("start"), F.max("last").alias("last_obs"), F.sum("n").alias("n"), root.alias("content_hash"), F.first("fingerprint").alias("fingerprint"))


def _files(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a folder of the cache."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _files(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
    return sorted(n for n in names if not n.startswith("."))  # a local disk keeps checksums beside files


def current_version(spark: SparkSession, path: str) -> str | None:
    """The newest version that was completed."""
    return max(_names(spark, f"{path}/versions"), default=None)


def _publish(spark: SparkSession, path: str, version: str, before: str | None) -> None:
    """The step that makes a version count: one empty file."""
    if current_version(spark, path) != before:
        raise RuntimeError("another writer has completed a version meanwhile")
    files, place = _files(spark, f"{path}/versions/{version}")
    files.create(place, False).close()


_ENTRY = "series_id string, month date, leaf string, n long, start date, last date, fingerprint string, version string"


def manifest(spark: SparkSession, path: str, version: str | None = None) -> DataFrame | None:
    """For every month of every series its hash and where its rows are; None for a cache without versions."""
    version = version or current_version(spark, path)
    return None if version is None else spark.read.schema(_ENTRY).parquet(f"{path}/manifest/{version}")


def write_cache(series: DataFrame, path: str, fingerprints: dict[str, str]) -> DataFrame:
    """Replace the series at hand, as a new version; other series stay. Only months whose content differs are written,
    and a reader sees the old version until all is there. Returns the series' metadata, with `revised` where the content
    differs from what the cache held. Empty series are refused; rows without a series or date don't count."""
    spark = series.sparkSession
    # Once: hash, rows and metadata are of the same data, whatever the source does meanwhile.
    rows = written(series.select("series_id", "date", F.col("value").cast("double").alias("value")).where("series_id IS NOT NULL AND date IS NOT NULL"))
    if rows.isEmpty():
        raise ValueError("nothing to cache")
    before = current_version(spark, path)
    version = f"{int(before.split('-')[0]) + 1 if before else 1:08d}-{uuid.uuid4().hex[:12]}"
    old = manifest(spark, path, before) if before else spark.createDataFrame([], _ENTRY)
    tags = F.create_map(*[F.lit(x) for kv in fingerprints.items() for x in kv])
    held = old.select("series_id", "month", F.col("leaf").alias("old_leaf"), F.col("version").alias("old_version"))
    entries = written(
        leaves(rows)
        .join(held, ["series_id", "month"], "left")
        .select("series_id", "month", "leaf", "n", "start", "last", F.element_at(tags, F.col("series_id")).alias("fingerprint"), F.when(F.col("old_leaf") == F.col("leaf"), F.col("old_version")).otherwise(version).alias("version"))
    )
    changed = entries.where(F.col("version") == version).select("series_id", "month")
    rows = rows.withColumn("month", F.trunc("date", "MM")).join(changed, ["series_id", "month"], "left_semi")
    rows.select("date", "value", "month", "series_id").repartition("series_id").write.partitionBy("series_id").parquet(f"{path}/data/version={version}")
    others = old.join(entries.select("series_id").distinct(), "series_id", "left_anti")
    entries.unionByName(others).write.parquet(f"{path}/manifest/{version}")
    _publish(spark, path, version, before)
    prior = roots(old).select("series_id", F.col("content_hash").alias("old_hash"))
    meta = roots(entries).join(prior, "series_id", "left")
    return meta.withColumn("revised", F.coalesce(F.col("old_hash") != F.col("content_hash"), F.lit(False))).drop("old_hash")


def load_meta(spark: SparkSession, path: str) -> DataFrame | None:
    entries = manifest(spark, path)
    return None if entries is None else roots(entries)


def load_cached(spark: SparkSession, path: str, ids: list[str], version: str | None = None) -> DataFrame:
    """The series asked for, of the newest version or another one that is still there. Only folders of versions that have
    months of theirs, and in them only these series, are read."""
    entries = manifest(spark, path, version).where(F.col("series_id").isin(ids)).select("series_id", "month", "version")
    folders = sorted(r.version for r in entries.select("version").distinct().collect())  # as many as revisions of them
    if not folders:
        return spark.createDataFrame([], "series_id string, date date, value double")
    data = spark.read.schema("date date, value double, month date, version string, series_id string").option("basePath", f"{path}/data").parquet(*[f"{path}/data/version={v}" for v in folders])
    return data.where(F.col("series_id").isin(ids)).join(entries, ["series_id", "month", "version"], "left_semi").select("series_id", "date", "value")


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete what the newest version doesn't need: other manifests, and data folders none of whose months are current, those
    of writers that failed among them. Returns the folders."""
    now = current_version(spark, path)
    used = {f"version={r.version}" for r in manifest(spark, path).select("version").distinct().collect()} if now else set()
    gone = [f"{path}/data/{f}" for f in _names(spark, f"{path}/data") if f not in used] + [f"{path}/{kind}/{f}" for kind in ("versions", "manifest") for f in _names(spark, f"{path}/{kind}") if f != now]
    for folder in gone:
        files, place = _files(spark, folder)
        files.delete(place, True)
    return gone


def covering(meta: DataFrame, fingerprints: dict[str, str], start: str, end: str) -> DataFrame:
    """Series whose cache has the same configuration and spans the window."""
    tags = F.create_map(*[F.lit(x) for kv in fingerprints.items() for x in kv])
    same = F.element_at(tags, F.col("series_id")) == F.col("fingerprint")
    return meta.where(same & (F.col("start") <= F.lit(start).cast("date")) & (F.col("last_obs") >= F.lit(end).cast("date"))).select("series_id")


def fetch_or_stale(refresh: Callable[[], DataFrame], spark: SparkSession, path: str, series_id: str, start: str, end: str, max_staleness_days: int) -> DataFrame:
    """Refresh; if that fails or comes back empty, serve a cache that covers the start and is fresh enough."""
    try:
        got = refresh()
        if not got.isEmpty():
            return got
        failure: Exception = ValueError(f"{series_id}: the refresh is empty")
    except (OSError, ValueError) as e:
        failure = e
    meta = load_meta(spark, path)
    fresh = F.datediff(F.lit(end).cast("date"), F.col("last_obs")) <= max_staleness_days
    if meta is not None and not meta.where((F.col("series_id") == series_id) & (F.col("start") <= F.lit(start).cast("date")) & fresh).isEmpty():
        return load_cached(spark, path, [series_id])
    raise failure
