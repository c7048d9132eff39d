"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(id as text) mod 4 is this are held out of every training set.
HELD_OUT_REMAINDER = 2
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir. Where the session names none, a temporary one serves on
    a local master, whose threads all see it; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="riskweave-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and read it from there: later uses neither
    recompute it nor depend on executors that may be lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def plain_planning(spark: SparkSession) -> Iterator[None]:
    """Plan without constraint propagation: checkpoints of loops carry their constraints along, which would
    grow with every round and take longer to plan than the rounds take to run."""
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def held_out(id_col: str = "doc_id") -> Column:
    """True for held-out rows; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT_REMAINDER


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about `max_bytes` of text (one row at least), to bound the memory of
    what is derived from them."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, min(stop, n) - start)
        start = stop


def sampled_ids(df: DataFrame, group: Column, id_col: str, most: int | dict, keep: Column, seed: int) -> tuple[dict, dict]:
    """({group: ids}, {group: eligible rows}): all ids of a group that has up to `most` eligible rows, else the
    `most` with the least hash. Two narrow scans: counts by group, then the rows whose hash lies below the
    share that the count asks for, with a margin; so about `most` ids a group reach the driver."""
    rows = df.where(keep & F.col(id_col).isNotNull()).select(group.alias("g"), F.col(id_col).alias("i"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"))
    rows = rows.where(F.col("g").isNotNull())
    counts = {r.g: r.n for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}  # one row a group
    if not counts:
        return {}, {}
    bound = {g: most[g] if isinstance(most, dict) else most for g in counts}
    share = {g: min(1.0, (1.5 * bound[g] + 64) / n) for g, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for g in counts for x in (g, int(share[g] * (1 << 40)))])
    near = rows.where(F.pmod("h", F.lit(1 << 40)) < F.element_at(limit, F.col("g"))).groupBy("g", "i", "h").agg(F.lit(1))
    found: dict = {g: [] for g in counts}
    for r in near.collect():
        found[r.g].append((r.h % (1 << 40), r.i))
    return {g: [i for _, i in sorted(ids)[: bound[g]]] for g, ids in found.items()}, counts


def sampled_texts(docs: DataFrame, ids: dict, id_col: str, text_col: str, most_bytes: int) -> dict:
    """{id: text} of a sample, {group: ids}: ids that repeat count once, with the least text. A group's texts are taken in
    the order of its ids while they fit its part of `most_bytes`; one that doesn't is left out whole, and the rest are
    looked at further. The sample's rows are written once and their sizes looked at before any text is fetched."""
    picked = [i for own in ids.values() for i in own]
    if not picked:
        return {}
    rows = docs.where(F.col(id_col).isin(picked) & F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(F.col(text_col)).alias("t"))
    rows = materialize(rows)
    sizes = {r.i: r.n for r in rows.select("i", F.octet_length("t").alias("n")).collect()}
    chosen = []
    for own in ids.values():
        left = most_bytes * len(own) // len(picked)
        for i in own:
            if i in sizes and sizes[i] <= left:
                left -= sizes[i]
                chosen.append(i)
    return {r.i: r.t for r in rows.where(F.col("i").isin(chosen)).collect()} if chosen else {}


def text_chunks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A long text in pieces of about `size` characters that end before ASCII white space, to bound the memory of
    what is derived from a piece; a word is never cut."""
    if len(text) <= size:
        yield text
        return
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + size)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
