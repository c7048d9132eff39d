"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A benchmark item's windows of ten consecutive words are the patterns; an item of fewer words is one pattern. Words
are numbered by the benchmark's vocabulary, so comparing numbers compares words. For each length of pattern a shift
table tells, by the last two words at a position, how far the search may skip; where it may not, the last and the
first two words select a bucket of patterns, and comparing all words confirms an occurrence. A batch of documents is
searched in many lanes at once, each skipping on its own.

The benchmark is split by hash into shards of some `SHARD_BYTES` of text; one shard's tables are broadcast at a time
and the documents are read once for each shard, so a benchmark of any size is searched whole.

Defined cases: a null text and one without words have no words and aren't contaminated; an item without words has no
window; a null item_id counts as the empty string; rows that repeat an item_id are one item with all their windows;
rows that repeat a doc_id are each judged; an empty benchmark finds nothing; an empty documents table gives an empty
result; a very long text is split into words a piece at a time and searched whole; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, text_slices

WINDOW = 10
#: Words in a block of the shift table.
BLOCK = 2
#: Text of one broadcast shard of the benchmark, in bytes; its tables take some ten times as much.
SHARD_BYTES = 16 << 20
#: Positions that one lane of the search goes through.
LANE = 256
_PIECE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A-Z to lower case; all other ASCII but digits and letters to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a UTF-8 text, in lists of a piece each."""
    if len(raw) <= _PIECE:
        yield raw.translate(_FOLD).split()
        return
    at = 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        while end < len(raw) and _FOLD[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(_FOLD).split()
        at = end


def _mixed(columns: Iterable[np.ndarray]) -> np.ndarray:
    out = np.uint64(0)
    for c in columns:
        out = (out + c.astype(np.uint64) + np.uint64(1)) * _MIX
        out = out ^ (out >> np.uint64(29))
    return out


@dataclass(frozen=True)
class Patterns:
    """All patterns of one length, with their shift table and buckets."""

    words: np.ndarray  # patterns x length, in order of `keys`
    keys: np.ndarray  # of the last and first words; equal keys are a bucket
    shift: np.ndarray  # by the hash of a block
    owner_at: np.ndarray  # pattern -> its items, owners[owner_at[p]:owner_at[p + 1]]
    owners: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, items: np.ndarray) -> Patterns:
        """rows: one window each, repeats included; items: the item of each."""
        words, inverse = np.unique(rows, axis=0, return_inverse=True)
        length, block = words.shape[1], min(BLOCK, words.shape[1])
        keys = cls._keys([words[:, j] for j in range(length)])
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[inverse.reshape(-1)], items], axis=1), axis=0)
        owner_at = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))
        bits = max(10, int(4 * words.size).bit_length())
        shift = np.full(1 << bits, length - block + 1, np.uint8)
        for last in range(block - 1, length):
            at = cls._block([words[:, j] for j in range(last - block + 1, last + 1)], bits)
            shift[at] = np.minimum(shift[at], length - 1 - last)
        return cls(words[order], keys[order], shift, owner_at, pairs[:, 1])

    @staticmethod
    def _keys(columns: list[np.ndarray]) -> np.ndarray:
        return _mixed(columns[-BLOCK:] + columns[:BLOCK])

    @staticmethod
    def _block(columns: list[np.ndarray], bits: int) -> np.ndarray:
        return (_mixed(columns) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, pattern) of all occurrences in `ids`."""
        length = self.words.shape[1]
        block, bits = min(BLOCK, length), int(len(self.shift)).bit_length() - 1
        at = np.arange(length - 1, len(ids), LANE)
        ends = np.minimum(at + LANE, len(ids))
        stops = [np.empty(0, np.int64)]
        while at.size:
            shift = self.shift[self._block([ids[at - j] for j in range(block - 1, -1, -1)], bits)]
            stops.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            on = at < ends
            at, ends = at[on], ends[on]
        first = np.concatenate(stops) - (length - 1)
        keys = self._keys([ids[first + j] for j in range(length)])
        low = np.searchsorted(self.keys, keys, "left")
        size = np.searchsorted(self.keys, keys, "right") - low
        first, low = np.repeat(first, size), np.repeat(low, size)
        pattern = low + np.arange(len(low)) - np.repeat(np.cumsum(size) - size, size)
        for j in range(length):
            same = ids[first + j] == self.words[pattern, j]
            first, pattern = first[same], pattern[same]
        return first, pattern


@dataclass(frozen=True)
class Tables:
    """A shard of the benchmark: its vocabulary, patterns by length, and item ids."""

    vocabulary: dict[bytes, int]
    patterns: list[Patterns]
    items: list[str]

    @classmethod
    def build(cls, rows: Iterable[tuple[str | None, str | None]], window: int = WINDOW) -> Tables:
        vocabulary: dict[bytes, int] = {}
        items: dict[str, int] = {}
        found: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item_id, text in rows:
            item = items.setdefault(item_id or "", len(items))
            words = [w for part in words_of((text or "").encode()) for w in part]
            if words:
                ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32)
                found[min(window, len(ids))].append((np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids))), item))
        patterns = [Patterns.build(np.concatenate([w for w, _ in ws]), np.repeat([i for _, i in ws], [len(w) for w, _ in ws])) for _, ws in sorted(found.items())]
        return cls(vocabulary, patterns, list(items))


def search(tables: Tables, texts: list[bytes | None]) -> list[tuple[int, int, list[tuple[int, int]], list[str]]]:
    """For each text: words, words hit, runs of hit words as (start, stop), items that occur."""
    known, parts, starts, n = tables.vocabulary.get, [], [0], 0
    for raw in texts:
        size = 0
        for words in words_of(raw) if raw else ():
            parts.append(np.fromiter(map(known, words, repeat(0)), np.int32, len(words)))
            size += len(words)
        parts.append(np.zeros(1, np.int32))  # no word is numbered 0, so nothing reaches over the end of a text
        n += size + 1
        starts.append(n)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    begin = np.array(starts)
    edge = np.zeros(len(ids) + 1, np.int32)
    items: dict[int, set[int]] = defaultdict(set)
    for p in tables.patterns:
        first, pattern = p.find(ids)
        if first.size:
            np.add.at(edge, first, 1)
            np.add.at(edge, first + p.words.shape[1], -1)
            pairs = np.unique(np.stack([np.searchsorted(begin, first, "right") - 1, pattern], axis=1), axis=0)
            for doc, k in pairs.tolist():
                items[doc].update(p.owners[p.owner_at[k] : p.owner_at[k + 1]].tolist())
    hit = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(hit))  # where runs begin and end, in turn
    runs = turns.reshape(-1, 2)
    at = np.searchsorted(runs[:, 0], begin)
    out = []
    for doc in range(len(texts)):
        own = (runs[at[doc] : at[doc + 1]] - begin[doc]).tolist()
        out.append((starts[doc + 1] - starts[doc] - 1, sum(b - a for a, b in own), own, sorted(tables.items[i] for i in items.get(doc, ()))))
    return out


def _scan(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """doc_id and what `search` finds for one shard, besides the columns that docs has beyond text."""
    rows = benchmark.select(F.col("item_id").cast("string"), "text").collect()  # a shard
    tables = docs.sparkSession.sparkContext.broadcast(Tables.build([(r.item_id, r.text) for r in rows], window))
    names = [f.name for f in docs.schema if f.name != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column(part.schema.get_field_index("text"))
                texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
                found = search(tables.value, texts.to_pylist())
                spans = pa.array([[{"start": a, "stop": b} for a, b in x[2]] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                new = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), spans, pa.array([x[3] for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + new, names=[*names, "n_words", "n_hit", "spans", "items"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, fields + ", n_words long, n_hit long, spans array<struct<start: long, stop: long>>, items array<string>")


def _merged(spans: Column) -> Column:
    """Sorted runs in which no two touch, from runs in any order."""
    last = lambda runs: F.element_at(runs, -1)
    grown = lambda runs, x: F.concat(
        F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last(runs)["start"].alias("start"), F.greatest(last(runs)["stop"], x["stop"]).alias("stop")))
    )
    empty = F.array().cast("array<struct<start: long, stop: long>>")
    return F.aggregate(F.array_sort(spans), empty, lambda runs, x: F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["stop"] >= x["start"]), grown(runs, x)).otherwise(F.concat(runs, F.array(x))))


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans (runs of hit words, from 0, stop not included) and items for every document."""
    rows = docs.select("doc_id", "text")
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    if n == 1:
        return _scan(rows, benchmark, window)
    # Equal rows get equal results, so a row's shards are put together by its id and a digest of its text.
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    shards = [_scan(rows, benchmark.where(mine == k), window) for k in range(n)]
    # The copies of a row fold before the shuffle; each shard has as many of them.
    found = materialize(_union([s.groupBy("doc_id", "digest", "n_words", "n_hit", "spans", "items").agg(F.count("*").alias("copies")) for s in shards]))
    spans = _merged(F.flatten(F.collect_list("spans")))
    whole = found.groupBy("doc_id", "digest").agg(F.first("n_words").alias("n_words"), F.first("copies").alias("copies"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return whole.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items", F.explode(F.expr("sequence(1, copies)")).alias("copy")).drop("copy")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def op12_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Windows as strings, joined on equality.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark
), bl AS (
  SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0
), bp AS (
  SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM bl
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS s FROM bp
), dl AS (
  SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m
), dw AS (
  SELECT rid, p, m, array_to_string(w[p:p + m - 1], ' ') AS s FROM dl
), o AS (
  SELECT dw.rid, dw.p, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.s = bw.s
), h AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM o) GROUP BY rid
), i AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM o GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN i ON d.rid = i.rid
"""
