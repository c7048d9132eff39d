"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Documents are range-sorted by that key within their source; a
distributed prefix sum of their sizes (sums by key range, prefix over the ranges, prefix within each
range) tells where a source's budget ends. A target above the source's size repeats whole epochs first.

Defined cases: a null text has size 0; a null source is a source of its own, the last in order; rows that
repeat a doc_id each count; rows equal in key, id and size are interchangeable, so ties don't change the
result as a set of rows; very long texts are counted whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Key ranges for each source. Sums by range are pre-aggregated; a range of the largest source is what one task sorts.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target.

    Water-filling: every source gets level * weight, up to `most` times its size, and the level is what
    makes the targets share `share` times the whole size. Sources are ordered by the level at which they
    fill up; the first prefix of full sources that leaves the rest below their caps fixes the level.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    # Windows over one row per source. Sources without words have no cap to fill and take nothing.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    per = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", w)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("fills_at", F.col("cap") / F.col("weight"))
        .withColumn("total", share * F.sum("source_size").over(whole))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level_here", (F.col("total") - F.col("full_before")) / F.col("open_weight"))
    )
    level = F.max(F.when(F.col("level_here") <= F.col("fills_at"), F.col("level_here"))).over(whole)
    return per.withColumn("level", level).select(
        "source",
        "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).cast("double").alias("target"),
    )


def mix(sized: DataFrame, targets: DataFrame, seed: int = 7, ranges: int = RANGES) -> DataFrame:
    """doc_id, source, size -> doc_id, size, source_size, target, taken.

    `taken` is epochs * size for all, and in the last, partial epoch the document's share of the words
    before the cut, so each source's sum is its target rounded down to a word.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = sized.withColumn("key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    keyed = keyed.withColumn("range", F.floor(F.col("key") / F.lit(2**60 // ranges)).cast("int"))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0))).select(
        F.col("source").alias("s"), F.col("range").alias("r"), "range_start"
    )
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("in_range", F.coalesce(F.sum("size").over(within), F.lit(0)))
    t = targets.select(F.col("source").alias("ts"), "source_size", "target")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("range_start") - F.col("in_range")
    return (
        placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .join(t, F.col("source").eqNullSafe(F.col("ts")))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(rest, F.col("size")))).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every document."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix(sized, source_targets(sized))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix in one process. A source's sums here run over all its documents at once.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, 2 * source_size AS cap, (2 * source_size) / weight AS fills_at, 1.5::DOUBLE * (SELECT CAST(sum(source_size) AS BIGINT) FROM s) AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_here
  FROM f
), t AS (
  SELECT source, source_size,
    least(cap::DOUBLE, coalesce((SELECT max(level_here) FROM l WHERE level_here <= fills_at) * weight, cap::DOUBLE)) AS target
  FROM l
), e AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS budget,
    CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs
  FROM t
), p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d
)
SELECT p.doc_id, p.size, e.source_size, e.target,
  CAST(e.epochs * p.size + greatest(0, least(e.budget - e.epochs * e.source_size - p.before, p.size)) AS BIGINT) AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""


def stage_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeat every document as often as the mix takes it.

    A document is kept whole, once for each epoch that takes any of its words; one of which the mix takes
    no word goes, and so does one without words, which carries no budget. A source exceeds its target by
    less than one document. Rows equal in id, source and size share the most copies that one of them has.
    """
    taken = (
        mixed_documents(docs)
        .where("taken > 0")
        .groupBy(F.col("doc_id").alias("__rw_id"), F.col("source").alias("__rw_source"), F.col("size").alias("__rw_size"))
        .agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("__rw_copies"))
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("__rw_id"))
        & F.col("source").eqNullSafe(F.col("__rw_source"))
        & (word_count(F.col("text")) == F.col("__rw_size"))
    )
    epochs = F.explode(F.sequence(F.lit(1), F.col("__rw_copies"))).alias("__rw_epoch")
    return docs.join(taken, same).select(*[docs[c] for c in docs.columns], epochs).drop("__rw_epoch")
