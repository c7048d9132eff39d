"""The vendor as a data source, and the versioned cache."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from riskweave.sources import cache
from riskweave.sources.vendor import vendor_series

SCHEMA = "series_id string, date date, value double"
DAY = dt.date(2024, 1, 1)


def vendor(log):
    def fetch(name, start, end):
        with open(f"{log}/{os.getpid()}-{time.time_ns()}", "w") as f:
            f.write(f"{name},{start},{end}")
        day = start - dt.timedelta(days=2)  # more than was asked for
        while day <= end:
            if day.day == 1:
                yield day, None if day.month == 6 else float(day.year + day.month / 100)
            day += dt.timedelta(days=1)

    return fetch


def asked(log):
    out = sorted((log / f).read_text() for f in os.listdir(log))
    for f in os.listdir(log):
        (log / f).unlink()
    return out


def test_partitions_that_filters_leave(spark, tmp_path):
    series = vendor_series(spark, ["a", "b", "late"], "2001-01-01", "2008-12-31", vendor(str(tmp_path)), {"late": 40}, {"a", "b", "late"}, {"old"}, years=4)
    rows = {(r.series_id, r.date): r.value for r in series.collect()}
    assert len(asked(tmp_path)) == 6 and len(rows) == 2 * 96 + 96
    assert rows["a", dt.date(2004, 6, 1)] is None and rows["b", dt.date(2008, 12, 1)] == 2008.12
    assert rows["late", dt.date(2001, 2, 10)] == 2001.01 and ("late", dt.date(2001, 1, 1)) not in rows
    one = series.where((F.col("series_id") == "b") & (F.col("date") >= dt.date(2003, 5, 1)) & (F.col("date") < dt.date(2003, 8, 1)))
    assert one.count() == 3 and asked(tmp_path) == ["b,2003-05-01,2003-07-31"]
    few = series.where(F.col("series_id").isin("a", "late") & (F.col("date") > dt.date(2005, 12, 31)) & (F.col("value") > 2008))
    assert {r.series_id for r in few.collect()} == {"a", "late"} and len(asked(tmp_path)) == 2
    assert series.where("series_id = 'nobody'").count() == 0 and asked(tmp_path) == []
    for bad in (["old"], ["unheard"], []):
        with pytest.raises(ValueError):
            vendor_series(spark, bad, "2001-01-01", "2001-12-31", vendor(str(tmp_path)), universe={"a", "old"}, discontinued={"old"})


def test_a_thousand_series_are_planned_at_once(spark, tmp_path):
    began = time.time()
    series = vendor_series(spark, [f"s{k}" for k in range(1000)], "2001-01-01", "2020-12-31", vendor(str(tmp_path)))
    assert series.columns == ["series_id", "date", "value"] and time.time() - began < 10
    assert series.where("series_id = 's7' AND date >= date'2020-01-01'").count() == 12 and len(asked(tmp_path)) == 1


def test_vendor_stream(spark, tmp_path):
    log, day = tmp_path / "log", tmp_path / "today"
    log.mkdir()
    day.write_text("2003-02-15")
    path = str(day)
    stream = vendor_series(spark, ["a", "b"], "2003-01-01", "2003-12-31", vendor(str(log)), stream=True, today=lambda: dt.date.fromisoformat(open(path).read()))
    q = stream.writeStream.format("memory").queryName("vendor_stream").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert spark.table("vendor_stream").count() == 4
        day.write_text("2004-07-01")
        q.processAllAvailable()
        assert spark.table("vendor_stream").count() == 24 and {r.series_id for r in spark.table("vendor_stream").collect()} == {"a", "b"}
    finally:
        q.stop()


def level(spark, values, name="s", start=DAY):
    return spark.createDataFrame([(name, start + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)], SCHEMA)


def stored(path):
    """Rows of data files by version."""
    import pyarrow.dataset as ds

    return {v: ds.dataset(f"{path}/data/{v}").count_rows() if any(f.endswith(".parquet") for _, _, fs in os.walk(f"{path}/data/{v}") for f in fs) else 0 for v in sorted(os.listdir(f"{path}/data"))}


def test_a_revision_rewrites_its_month(spark, tmp_path):
    path, tag = str(tmp_path / "c"), {"s": "f", "t": "g"}
    values = [float(k) if k % 9 else None for k in range(200)]
    cache.write_cache(level(spark, values).union(level(spark, values[:50], "t")), path, tag)
    first = cache.load_meta(spark, path).orderBy("series_id").collect()
    assert [(r.series_id, r.n, r.start, r.fingerprint) for r in first] == [("s", 200, DAY, "f"), ("t", 50, DAY, "g")]
    same = cache.write_cache(level(spark, values), path, tag).first()
    assert not same.revised and same.content_hash == first[0].content_hash
    values[40] += 1e-3
    assert cache.write_cache(level(spark, values), path, tag).first().revised
    assert list(stored(path).values()) == [250, 0, 29]  # all, nothing, February
    got = {(r.series_id, r.date): r.value for r in cache.load_cached(spark, path, ["s", "t"]).collect()}
    assert len(got) == 250 and got["s", DAY + dt.timedelta(40)] == values[40] and got["s", DAY] is None
    shorter = cache.write_cache(level(spark, values[:100]), path, tag).first()
    assert shorter.revised and shorter.n == 100 and cache.load_cached(spark, path, ["s"]).count() == 100
    old = cache._names(spark, f"{path}/versions")[0]
    assert cache.load_cached(spark, path, ["s"], old).count() == 200
    assert cache.load_cached(spark, path, ["nobody"]).collect() == []


def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path, tag = str(tmp_path / "c"), {"s": "f"}
    assert cache.load_meta(spark, path) is None
    cache.write_cache(level(spark, [1, 2, 3]), path, tag)
    before = cache.load_meta(spark, path).first()
    publish = cache._publish

    def crash(*_):
        raise OSError("gone")

    monkeypatch.setattr(cache, "_publish", crash)
    with pytest.raises(OSError):
        cache.write_cache(level(spark, [1, 2, 9]), path, tag)
    assert cache.load_meta(spark, path).first() == before and [r.value for r in cache.load_cached(spark, path, ["s"]).orderBy("date").collect()] == [1, 2, 3]
    monkeypatch.setattr(cache, "_publish", lambda spark, path, version, was: publish(spark, path, version, "another"))
    with pytest.raises(RuntimeError, match="another writer"):
        cache.write_cache(level(spark, [1, 2, 9]), path, tag)
    monkeypatch.setattr(cache, "_publish", publish)
    gone = cache.vacuum(spark, path)
    assert sum("/data/" in g for g in gone) == 2 and cache.load_cached(spark, path, ["s"]).count() == 3
    with pytest.raises(ValueError, match="nothing"):
        cache.write_cache(level(spark, []), path, tag)


def test_the_tree_is_of_content_only(spark, tmp_path):
    rows = level(spark, [1 / 3, None, float("nan"), 1e300, -0.0])
    a = cache.write_cache(rows.repartition(3), str(tmp_path / "a"), {"s": "f"}).first()
    b = cache.write_cache(rows.orderBy(F.desc("date")).withColumn("value", F.col("value") * (1 + 1e-15)), str(tmp_path / "b"), {"s": "f"}).first()
    assert a.content_hash == b.content_hash
    c = cache.write_cache(rows.withColumn("value", F.coalesce("value", F.lit(0.0))), str(tmp_path / "c"), {"s": "f"}).first()
    assert a.content_hash != c.content_hash
