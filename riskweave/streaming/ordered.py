"""Folds and as-of joins of streams in event-time order.

Rows arrive in any order. Each waits in its key's buffer until the watermark has passed its time: then no earlier one can
come, a timer fires, and what is due is folded in order of time. So the results are those of the batch fold, whatever
micro-batches the rows came in. Rows later than the watermark aren't folded; Spark counts them
(`numRowsDroppedByWatermark` in a query's progress). The buffer holds a watermark's length of rows a key, one entry a
time, in the RocksDB state store; what waits when a stream stops is folded when it goes on.

Defined cases: rows without a time are dropped; rows of one time are folded in the order of `ties`, else as they came; a
null key is a key; states and inputs are numbers, booleans, strings, lists of them, or None.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import Step

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ordered(StatefulProcessor):
    def __init__(self, key: str, inputs: list[str], start: Any, step: Step, names: list[str], ties: int | None):
        self.key, self.inputs, self.start, self.step, self.names, self.ties = key, inputs, start, step, names, ties

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")
        self.waiting = handle.getMapState("waiting", "us long", "rows string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        new: dict[int, list] = {}
        for r in rows:
            new.setdefault(r["__us"], []).append([r[c] for c in self.inputs])
        for us, values in new.items():
            held = json.loads(self.waiting.getValue((us,))[0]) if self.waiting.containsKey((us,)) else []
            self.waiting.updateValue((us,), (json.dumps(held + values),))
            if not held:
                self.handle.registerTimer(-(-us // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted(k[0] for k in self.waiting.keys() if k[0] <= until)
        if not due:
            return
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.start
        for us in due:
            rows = json.loads(self.waiting.getValue((us,))[0])
            self.waiting.removeKey((us,))
            for values in rows if self.ties is None else sorted(rows, key=lambda v: v[self.ties]):
                state = tuple(state) if isinstance(state, list) else state
                state, out = self.step(state, tuple(values))
                yield Row(**{self.key: key[0], "__us": us, **dict(zip(self.inputs, values)), **dict(zip(self.names, out))})
        self.state.update((json.dumps(state),))

    def close(self) -> None:
        pass


def ordered_fold(stream: DataFrame, inputs: list[str], start: Any, step: Step, outputs: str, order: str = "date", watermark: str = "7 days", key: str = "series_id", ties: str | None = None) -> DataFrame:
    """(key, order, inputs..., outputs...) of `step` along each key in order of time. The session's state store is set to
    RocksDB, which timers and maps need."""
    conf = stream.sparkSession.conf
    if conf.get(_PROVIDER, None) != _ROCKSDB:
        conf.set(_PROVIDER, _ROCKSDB)
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    names = [o.split()[0] for o in outputs.split(",")]
    timed = stream.where(F.col(order).isNotNull()).withColumn("__ts", F.col(order).cast("timestamp")).withWatermark("__ts", watermark).withColumn("__us", F.unix_micros("__ts"))
    schema = f"`{key}` {fields[key]}, `__us` long, " + ", ".join(f"`{c}` {fields[c]}" for c in inputs) + ", " + outputs
    work = _Ordered(key, inputs, start, step, names, None if ties is None else inputs.index(ties))
    out = timed.select(key, "__ts", "__us", *inputs).groupBy(key).transformWithState(work, schema, "append", "EventTime")
    return out.select(key, F.timestamp_micros("__us").cast(fields[order]).alias(order), *inputs, *names)


def _carried(state: Any, row: tuple) -> tuple[Any, tuple]:
    """The last value of the right side; rows of the left one take it along."""
    right, value = row[0] == 0, row[1]
    state = value if right and value is not None else state
    return state, (state,)


def stream_asof(left: DataFrame, right: DataFrame, value: str, order: str = "date", watermark: str = "7 days", key: str = "series_id") -> DataFrame:
    """(key, order, left's `value`, asof_value): each row of the left stream with the last value of the right one up to its
    time, that of the same time included, as the batch as-of join has it."""
    kind = dict(left.dtypes)[value]
    none = F.lit(None).cast(kind)
    a = left.select(key, order, F.lit(1).alias("side"), none.alias("given"), F.col(value).alias("own"))
    b = right.select(key, order, F.lit(0).alias("side"), F.col(value).cast(kind).alias("given"), none.alias("own"))
    both = ordered_fold(a.unionByName(b), ["side", "given", "own"], None, _carried, f"asof_value {kind}", order, watermark, key, ties="side")
    return both.where("side = 1").select(key, order, F.col("own").alias(value), "asof_value")
