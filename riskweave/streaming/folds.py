"""The folds on input that comes in order: each series keeps its fold state in the state store. Rows that come out of order
are for `ordered`, which waits for the watermark."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.folds import Step


def stream_fold(stream: DataFrame, inputs: list[str], start: Any, step: Step, outputs: str, order: str = "date") -> DataFrame:
    """The streaming counterpart of `fold`: (series_id, date, inputs..., outputs...), without delay. The state is JSON, so
    it must be numbers, booleans, strings, lists of them, or None. Rows may be in any order within a micro-batch; one
    that comes before what was folded already is an error."""
    names = [o.split()[0] for o in outputs.split(",")]
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    columns = ["series_id", order, *inputs]
    schema = ", ".join(f"`{c}` {fields[c]}" for c in columns) + ", " + outputs

    def run(key: tuple, frames: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        state, last = json.loads(store.get[0]) if store.exists else (start, None)
        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")[columns]
        if last is not None and str(pdf[order].iloc[0]) < last:
            raise ValueError(f"{key[0]}: a row of {pdf[order].iloc[0]} comes after one of {last}; ordered_fold takes rows in any order")
        rows = []
        for values in zip(*(pdf[c].tolist() for c in inputs)):
            state = tuple(state) if isinstance(state, list) else state
            state, out = step(state, values)
            rows.append(out)
        store.update((json.dumps((state, str(pdf[order].iloc[-1]))),))
        for k, name in enumerate(names):
            pdf[name] = [r[k] for r in rows]
        yield pdf

    return stream.groupBy("series_id").applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")


def publication_window(stream: DataFrame, lag_days: int, watermark: str = "7 days") -> DataFrame:
    """Rows become available `lag_days` after their date; the watermark bounds how late they may come."""
    timed = stream.withColumn("available", F.date_add("date", lag_days).cast("timestamp"))
    return timed.withWatermark("available", watermark)


def session_levels(stream: DataFrame, gap: str = "3 days", watermark: str = "7 days") -> DataFrame:
    """Mean and count of each session: rows of a series with less than `gap` between neighbours."""
    timed = stream.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", watermark)
    per = timed.groupBy("series_id", F.session_window("ts", gap).alias("w")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return per.select("series_id", "w.start", "w.end", "mean", "n")


def windowed_levels(stream: DataFrame, size: str = "7 days", slide: str | None = None, watermark: str | None = "7 days", time: str = "date") -> DataFrame:
    """Mean, count and last value of tumbling or sliding event-time windows. A stream that has its watermark already
    (as from publication_window, on `available`) is given with `watermark` None and that column as `time`."""
    timed = stream.withColumn("ts", F.col(time).cast("timestamp")).withWatermark("ts", watermark) if watermark else stream.withColumn("ts", F.col(time))
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed.groupBy("series_id", frame.alias("w")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"), F.max_by("value", "ts").alias("last")).select("series_id", "w.start", "w.end", "mean", "n", "last")
