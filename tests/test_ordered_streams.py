"""Streams whose rows come out of order fold as the batch does."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import calendar, folds
from riskweave.streaming.ordered import ordered_fold, stream_asof

DAY = dt.date(2020, 1, 1)
END = DAY + dt.timedelta(days=4000)


def batches(rows, size):
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def run(spark, tmp_path, make, schemas, feeds):
    """Feed lists of batches to as many streams, one batch of each at a time; returns the rows and the last progress."""
    dirs = [tmp_path / f"in{k}" for k in range(len(schemas))]
    for d in dirs:
        d.mkdir()
    streams = [spark.readStream.schema(s).json(str(d)) for s, d in zip(schemas, dirs)]
    name = f"out{abs(hash(str(tmp_path)))}"
    q = make(*streams).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    dropped = 0
    try:
        for k in range(max(map(len, feeds))):
            for d, feed in zip(dirs, feeds):
                if k < len(feed):
                    (d / f"tmp-{k}").write_text("\n".join(json.dumps(r, default=str) for r in feed[k]))
                    (d / f"tmp-{k}").rename(d / f"part-{k}.json")
            q.processAllAvailable()
        seen = {p["batchId"]: p for p in map(lambda p: p if isinstance(p, dict) else json.loads(p.json), q.recentProgress)}
        dropped = sum(s["numRowsDroppedByWatermark"] for p in seen.values() for s in p["stateOperators"])
    finally:
        q.stop()
    return spark.table(name), dropped


def shuffled_within(rows, days, seed):
    """In an order in which no row comes more than `days` after a later one."""
    draw = random.Random(seed)
    return sorted(rows, key=lambda r: (r["date"] - DAY).days + draw.uniform(0, days))


def test_shuffled_stream_folds_as_the_batch(spark, tmp_path):
    draw = random.Random(1)
    rows = [{"series_id": s, "date": DAY + dt.timedelta(days=i), "ret": draw.gauss(0, 0.01)} for s in "ab" for i in range(60)]
    feed = batches(shuffled_within(rows, 6, 2), 40) + [[{"series_id": s, "date": END, "ret": 0.0} for s in "ab"]]
    late = [{"series_id": "a", "date": DAY, "ret": 9.0}]  # long after the watermark
    schema = "series_id string, date date, ret double"
    out, dropped = run(spark, tmp_path, lambda s: ordered_fold(s, ["ret"], 1e-4, folds.ewma_step(0.94), "sigma double"), [schema], [[*feed, late]])
    got = {(r.series_id, r.date): r.sigma for r in out.collect()}
    whole = folds.ewma_vol(spark.createDataFrame([(r["series_id"], r["date"], r["ret"]) for r in rows], schema), first_var=1e-4)
    assert got == pytest.approx({(r.series_id, r.date): r.sigma for r in whole.collect()})
    assert dropped == 1


def test_streaming_asof_join_is_the_batch_one(spark, tmp_path):
    draw = random.Random(3)
    left = [{"series_id": s, "date": DAY + dt.timedelta(days=i), "value": float(i)} for s in "ab" for i in range(40)]
    right = [{"series_id": s, "date": DAY + dt.timedelta(days=i), "value": draw.random()} for s in "ab" for i in range(3, 40, 5)]
    end = [{"series_id": s, "date": END, "value": -1.0} for s in "ab"]
    schema = "series_id string, date date, value double"
    feeds = [batches(shuffled_within(left, 5, 4), 20) + [end, end[:1]], batches(shuffled_within(right, 5, 5), 4) + [end, end[:1]]]
    out, _ = run(spark, tmp_path, lambda a, b: stream_asof(a, b, "value"), [schema, schema], feeds)
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    batch = calendar.asof_join(frame(left), frame(right).withColumnRenamed("value", "asof_value"), ["asof_value"], keys=["series_id"])
    want = {(r.series_id, r.date, r.value): r.asof_value for r in batch.collect()}
    got = {(r.series_id, r.date, r.value): r.asof_value for r in out.where(F.col("date") < F.lit(END)).collect()}
    assert got == want and sum(v is None for v in got.values()) == 6
