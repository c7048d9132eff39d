"""A vendor as a data source: one partition a (series, span of years), fetched by executors.

`fetch(series_id, first day, last day)` gives (date, value) pairs; it runs in tasks, so it must be picklable and reach the
vendor from there. Filters on the id and the date decide which partitions are asked for at all. As a stream, each
micro-batch is the next days of all series.

Series that are published late are asked for from so many days earlier, and their values are dated when they were known.
Missing values stay as they are; values outside the asked span are left out.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .series import checked_ids

Fetch = Callable[[str, dt.date, dt.date], Iterable[tuple[dt.date, float | None]]]
SCHEMA = "series_id string, date date, value double"
_DAY = dt.timedelta(1)


class Span(InputPartition):
    def __init__(self, series_id: str, start: dt.date, end: dt.date):
        self.series_id, self.start, self.end = series_id, start, end


def rows_of(fetch: Fetch, span: Span, lag: int) -> Iterator[tuple[str, dt.date, float | None]]:
    """A span's rows, by the day on which they were known."""
    late = dt.timedelta(lag)
    for day, value in fetch(span.series_id, span.start - late, span.end - late):
        if span.start <= day + late <= span.end:
            yield span.series_id, day + late, None if value is None else float(value)


class SeriesReader(DataSourceReader):
    def __init__(self, fetch: Fetch, ids: list[str], lags: dict[str, int], start: dt.date, end: dt.date, years: int):
        self.fetch, self.ids, self.lags, self.start, self.end, self.years = fetch, ids, lags, start, end, years

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Narrow the ids and the span; Spark checks other filters itself."""
        for f in filters:
            match f:
                case EqualTo(("series_id",), str(value)):
                    self.ids = [i for i in self.ids if i == value]
                case In(("series_id",), values):
                    self.ids = [i for i in self.ids if i in set(values)]
                case EqualTo(("date",), dt.date() as day):
                    self.start, self.end = max(self.start, day), min(self.end, day)
                case GreaterThanOrEqual(("date",), dt.date() as day):
                    self.start = max(self.start, day)
                case GreaterThan(("date",), dt.date() as day):
                    self.start = max(self.start, day + _DAY)
                case LessThanOrEqual(("date",), dt.date() as day):
                    self.end = min(self.end, day)
                case LessThan(("date",), dt.date() as day):
                    self.end = min(self.end, day - _DAY)
                case _:
                    yield f

    def partitions(self) -> list[Span]:
        spans = []
        for first in range(self.start.year, self.end.year + 1, self.years):
            a, b = max(self.start, dt.date(first, 1, 1)), min(self.end, dt.date(first + self.years - 1, 12, 31))
            if a <= b:
                spans += [Span(i, a, b) for i in self.ids]
        return spans or [Span("", dt.date.max, dt.date.min)]  # nothing is asked for

    def read(self, partition: Span) -> Iterator[tuple]:
        if partition.start <= partition.end:
            yield from rows_of(self.fetch, partition, self.lags.get(partition.series_id, 0))


class SeriesStream(DataSourceStreamReader):
    """An offset is the first day that hasn't been read; `today` tells how far there is anything to read."""

    def __init__(self, fetch: Fetch, ids: list[str], lags: dict[str, int], start: dt.date, end: dt.date, today: Callable[[], dt.date]):
        self.fetch, self.ids, self.lags, self.start, self.end, self.today = fetch, ids, lags, start, end, today

    def initialOffset(self) -> dict:  # noqa: N802
        return {"day": self.start.isoformat()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"day": max(self.start, min(self.today(), self.end) + _DAY).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        a, b = dt.date.fromisoformat(start["day"]), dt.date.fromisoformat(end["day"]) - _DAY
        return [Span(i, a, b) for i in self.ids] if a <= b else []

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from rows_of(self.fetch, partition, self.lags.get(partition.series_id, 0))


def vendor_source(fetch: Fetch, today: Callable[[], dt.date] = dt.date.today) -> type[DataSource]:
    """A data source of a vendor, for spark.dataSource.register(). Options: `ids` and `lags` as JSON, `start`, `end`, and
    `years` of a partition."""

    class Series(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"series_{label}"

        def schema(self) -> str:
            return SCHEMA

        def _asked(self) -> tuple:
            days = [dt.date.fromisoformat(self.options[k]) for k in ("start", "end")]
            return fetch, json.loads(self.options["ids"]), json.loads(self.options.get("lags", "{}")), *days

        def reader(self, schema) -> SeriesReader:
            return SeriesReader(*self._asked(), int(self.options.get("years", 10)))

        def streamReader(self, schema) -> SeriesStream:  # noqa: N802
            return SeriesStream(*self._asked(), today)

    label = uuid.uuid4().hex[:8]
    return Series


def vendor_series(
    spark: SparkSession, ids: Iterable[str], start: str, end: str, fetch: Fetch, lags: dict[str, int] | None = None, universe: Iterable[str] | None = None, discontinued: Iterable[str] = (), years: int = 10,
    stream: bool = False, today: Callable[[], dt.date] = dt.date.today,
) -> DataFrame:
    """Long series from a vendor, nothing filled, as a scan or a stream. Discontinued and unknown ids are refused."""
    asked = checked_ids(ids, universe, discontinued)
    if not asked:
        raise ValueError("no series asked for")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = vendor_source(fetch, today)
    spark.dataSource.register(source)
    reader = (spark.readStream if stream else spark.read).format(source.name())
    return reader.options(ids=json.dumps(asked), lags=json.dumps(lags or {}), start=start, end=end, years=years).load()
