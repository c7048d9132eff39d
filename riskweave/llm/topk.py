"""Exact top-k inner products by a dual-tree search over cover trees.

Vectors are quantised to integers, so scores are exact. The points of one level of a cover tree over a bounded
sample are cells; every row goes to the nearest. Cells are what the plan is made of: their number is bounded
(`CELLS`), whatever the table. A cell's rows are dealt by hash over blocks of bounded size, and queries of
neighbouring cells form bands, dealt over groups of bounded size, so a cell with a third of all rows is many
blocks. Where a group meets a block, both sides build their cover trees and the two are descended together. A pair
of nodes is pruned when even its best possible score, from the centres' product and both covering radii,

    q.p <= cq.cp + |cq| rp + |cp| rq + rq rp,

is below the worst k-th score among the queries in the query node. The same bound decides which cells a band
meets at all, in rounds: its own cells first, then the most promising others, then what the k-th scores found so
far can't exclude. Every round starts from the k-th scores of the rounds before it.

What is broadcast or collected: the cells' centres and sums (`CELLS` rows) and a round's pairs of bands and cells
(`CELLS` squared at most). Where vectors don't cluster at all, nothing can be pruned and every query meets every
row, as matrix products of a group and a block.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows
without an id or of another length than the most common one; rows that repeat a vec_id are each a query (their
ranks come once for each) and each a candidate for all other rows; fewer than k candidates give fewer rows; ties
go to the smaller vec_id; scores beyond a long end at its limits; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

TOP = 20
SCALE = 64
EVERY = 20
#: Vectors on which cells are chosen; cells at most, and rows a cell should have on average at least.
SAMPLE = 4096
CELLS = 1024
CELL_ROWS = 2048
#: Rows in a block and queries in a group, about; rows in a leaf of their trees.
BLOCK = 8192
GROUP = 1024
LEAF = 256
#: How many cells a band meets in the second round.
PROMISING = 8
LOWEST = -(2**62)


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def level(x: np.ndarray, first: int, radius: float, most: int) -> list[int]:
    """Points that cover `x` within `radius` and are more than `radius` apart, farthest first: a cover
    tree's level below one of twice the radius. At most `most` of them."""
    chosen = [first]
    near = distances(x, x[first])
    while len(chosen) < most:
        far = int(near.argmax())
        if near[far] <= radius:
            break
        chosen.append(far)
        near = np.minimum(near, distances(x, x[far]))
    return chosen


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, centre: int | None = None, leaf: int = LEAF) -> Node:
    """Every node is a point with the radius that covers its rows; the first child is the point itself."""
    rows = np.arange(len(x)) if rows is None else rows
    if centre is None:
        centre = int(rows[distances(x[rows], x[rows].mean(axis=0)).argmin()])
    own = x[rows]
    radius = float(distances(own, x[centre]).max()) * (1 + 1e-9)
    if len(rows) <= leaf or radius == 0:
        return Node(x[centre], radius, rows, [])
    points = level(own, int(np.flatnonzero(rows == centre)[0]), radius / 2, 16)
    nearest = np.stack([distances(own, own[c]) for c in points]).argmin(axis=0)
    nearest[points] = np.arange(len(points))
    return Node(x[centre], radius, rows, [cover_tree(x, rows[nearest == k], int(rows[c]), leaf) for k, c in enumerate(points)])


def most_possible(cq: np.ndarray, rq: np.ndarray | float, cp: np.ndarray, rp: np.ndarray | float) -> np.ndarray:
    """The highest score between balls (the last axes are vectors); what is added covers rounding, as scores are
    whole numbers."""
    lq, lp = np.sqrt((cq * cq).sum(axis=-1)), np.sqrt((cp * cp).sum(axis=-1))
    return (cq * cp).sum(axis=-1) + lq * rp + lp * rq + rq * rp + 0.5 + 1e-9 * (lq + rq) * (lp + rp)


class Best:
    """The k best candidates found for each query. `kth` is the least score that can still enter."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.kth = k, floor.astype(np.int64)
        self.score = np.full((n, k), LOWEST - 1, np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def offer(self, queries: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates with `score` and `ids` for queries[row]."""
        some = np.unique(row)
        at = queries[some]
        rows = np.concatenate((np.repeat(np.arange(len(some)), self.k), np.searchsorted(some, row)))
        scores, all_ids = np.concatenate((self.score[at].ravel(), score)), np.concatenate((self.ids[at].ravel(), ids))
        order = np.lexsort((all_ids, -scores, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = order[place < self.k]  # every row had k entries before
        self.score[at], self.ids[at] = scores[kept].reshape(-1, self.k), all_ids[kept].reshape(-1, self.k)
        self.kth[at] = np.maximum(self.kth[at], self.score[at, -1])


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, in the narrowest arithmetic that holds them."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * q.shape[1]
    if most < 2**24:
        return (q.astype(np.float32) @ p.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ p.astype(object).T
    return np.clip(exact, LOWEST, 2**63 - 1).astype(np.int64)


@dataclass
class Search:
    qx: np.ndarray
    px: np.ndarray
    qrow: np.ndarray
    prow: np.ndarray
    pid: np.ndarray
    best: Best

    def descend(self, q: Node, p: Node) -> None:
        """Both trees at once, the most promising candidate nodes first."""
        if most_possible(q.centre, q.radius, p.centre, p.radius) < self.best.kth[q.rows].min():
            return
        if not q.children and not p.children:
            self.compare(q.rows, p.rows)
        elif q.children and (not p.children or q.radius >= p.radius):
            for child in q.children:
                self.descend(child, p)
        else:
            for child in sorted(p.children, key=lambda c: -most_possible(q.centre, q.radius, c.centre, c.radius)):
                self.descend(q, child)

    def compare(self, q: np.ndarray, p: np.ndarray) -> None:
        scores = products(self.qx[q], self.px[p])
        own = self.qrow[q][:, None] == self.prow[p][None, :]
        least = self.best.kth[q]
        k = self.best.k
        if len(p) > k and (least == LOWEST).any():
            # of so many candidates only the k best can matter, and ties with them; one may be the query itself
            least = np.maximum(least, np.partition(scores, len(p) - k - 1, axis=1)[:, len(p) - k - 1])
        row, col = np.nonzero((scores >= least[:, None]) & ~own)
        if len(row):
            self.best.offer(q, row, scores[row, col], self.pid[p[col]])


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integer vector, of every row that takes part."""
    x = F.col(vector_col)
    fine = F.coalesce(F.size(x) > 0, F.lit(False)) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long")).alias("v")
    )


def packed(x: np.ndarray) -> list[bytes]:
    """Each vector's bytes, two a component where that holds it, else eight."""
    small = (np.abs(x) < 2**15).all(axis=1)
    out = [b""] * len(x)
    for rows, kind in ((np.flatnonzero(small), "<i2"), (np.flatnonzero(~small), "<i8")):
        for i, v in zip(rows.tolist(), x[rows].astype(kind)):
            out[i] = v.tobytes()
    return out


def unpacked(column: pd.Series, width: int) -> np.ndarray:
    values = column.to_list()
    kinds = {2 * width: "<i2", 8 * width: "<i8"}
    if len({len(b) for b in values}) == 1:
        return np.frombuffer(b"".join(values), kinds[len(values[0])]).reshape(-1, width).astype(np.int64)
    return np.stack([np.frombuffer(b, kinds[len(b)]).astype(np.int64) for b in values])


def dealt(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """row (a number of its own), vec_id, v as bytes, the nearest cell and the distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        half = (centres * centres).sum(axis=1) / 2
        for pdf in batches:
            if len(pdf):
                whole = np.stack(pdf["v"].to_numpy())
                x = whole.astype(np.float64)
                near = (x @ centres.T - half).argmax(axis=1)
                yield pd.DataFrame({"row": pdf["row"], "vec_id": pdf["vec_id"], "v": packed(whole), "cell": near.astype(np.int32), "reach": distances(x, centres[near])})

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    return numbered.mapInPandas(run, "row long, vec_id long, v binary, cell int, reach double")


def found(queries: DataFrame, candidates: DataFrame, k: int, width: int) -> DataFrame:
    """(qrow, vec_id, score): the best k of each meeting of a group and a block, keyed alike on both sides."""
    none = pd.DataFrame({"qrow": [], "vec_id": [], "score": []}, dtype="int64")
    keys = ["band", "group", "cell", "block"]

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return none
        qx, px = unpacked(q["v"], width), unpacked(p["pv"], width)
        best = Best(len(q), k, q["kth"].to_numpy())
        search = Search(qx, px, q["row"].to_numpy(), p["prow"].to_numpy(), p["pid"].to_numpy(), best)
        search.descend(cover_tree(qx.astype(np.float64)), cover_tree(px.astype(np.float64)))
        on = best.score >= LOWEST
        return pd.DataFrame({"qrow": np.repeat(search.qrow, on.sum(axis=1)), "vec_id": best.ids[on], "score": best.score[on]})

    # new names: both sides come from one table
    theirs = candidates.select(F.col("row").alias("prow"), F.col("vec_id").alias("pid"), F.col("v").alias("pv"), *(F.col(c).alias(f"p_{c}") for c in keys))
    both = queries.select("row", "v", "kth", *keys).groupBy(*keys).cogroup(theirs.groupBy(*(f"p_{c}" for c in keys)))
    return both.applyInPandas(run, "qrow long, vec_id long, score long")


@dataclass
class Cells:
    """The plan's side of the cells: at most CELLS of them."""

    centres: np.ndarray
    #: rows, radius over all rows, queries, radius over the queries
    n: np.ndarray
    reach: np.ndarray
    n_queries: np.ndarray
    reach_queries: np.ndarray
    #: the band of each cell's queries, and the groups of each band
    band: np.ndarray
    groups: np.ndarray

    def blocks(self, size: int) -> np.ndarray:
        return np.maximum(1, -(-self.n // size))


def summed(placed: DataFrame, centres: np.ndarray, every: int, group: int) -> Cells:
    asks = F.col("vec_id") % every == 0
    sums = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("r"), F.count_if(asks).alias("q"), F.max(F.when(asks, F.col("reach"))).alias("rq")).collect()
    m = len(centres)
    n, reach, nq, rq = np.zeros(m, np.int64), np.zeros(m), np.zeros(m, np.int64), np.zeros(m)
    for s in sums:
        n[s.cell], reach[s.cell], nq[s.cell], rq[s.cell] = s.n, s.r, s.q, s.rq or 0.0
    # neighbours in a row: by the nearest of a few far-apart centres
    far = centres[: max(1, int(m**0.5))]
    order = np.lexsort((np.arange(m), np.stack([distances(centres, c) for c in far]).argmin(axis=0)))
    band, groups, held, at = np.zeros(m, np.int64), [], 0, -1
    for c in order.tolist():
        if at < 0 or held + nq[c] > group:
            at, held = at + 1, 0
            groups.append(0)
        band[c] = at
        held += int(nq[c])
        groups[at] = max(1, -(-held // group))
    return Cells(centres, n, reach * (1 + 1e-9), nq, rq * (1 + 1e-9), band, np.array(groups or [1], np.int64))


def open_pairs(cells: Cells, worst: np.ndarray, done: np.ndarray, most: int | None) -> np.ndarray:
    """A band x cell table of what is to meet now: cells whose bound reaches the worst k-th score of one of the
    band's cells and that the band hasn't met. With `most`, only so many, those with the highest bounds."""
    out = np.zeros(done.shape, bool)
    for b in range(len(done)):
        own = np.flatnonzero((cells.band == b) & (cells.n_queries > 0))
        if not len(own):
            continue
        bound = np.full(len(cells.n), -np.inf)
        for c in own.tolist():
            most_ = most_possible(cells.centres[c][None, :], cells.reach_queries[c], cells.centres, cells.reach)
            bound = np.maximum(bound, np.where(most_ >= worst[c], most_, -np.inf))
        bound[done[b] | (cells.n == 0)] = -np.inf
        pick = np.flatnonzero(bound > -np.inf)
        if most is not None:
            pick = pick[np.argsort(-bound[pick], kind="stable")[:most]]
        out[b, pick] = True
    return out


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, block: int = BLOCK, group: int = GROUP, cell_rows: int = CELL_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    width, total = (sizes[0].n, sizes[0].c) if sizes else (1, 0)
    rows = rows.where(F.size("v") == width)
    # bounded by SAMPLE: one vector for each of so many hash buckets
    seen = rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(SAMPLE)).alias("b")).agg(F.min_by("v", "vec_id").alias("v")).collect()
    sample = np.array([r.v for r in seen], np.float64) if seen else np.zeros((1, width))
    middle = int(distances(sample, sample.mean(axis=0)).argmin())
    centres = sample[level(sample, middle, 0.0, max(1, min(CELLS, total // cell_rows)))]
    placed = materialize(dealt(rows, centres))
    cells = summed(placed, centres, every, group)
    blocks = cells.blocks(block)
    of_cell = spark.createDataFrame([(c, int(b), int(cells.groups[b])) for c, b in enumerate(cells.band.tolist())], "cell int, band int, groups int")
    asking = placed.where(F.col("vec_id") % every == 0).join(F.broadcast(of_cell), "cell")
    queries = asking.select("row", F.col("vec_id").alias("query_id"), "v", F.col("cell").alias("own"), "band", F.pmod(F.xxhash64("row"), F.col("groups")).cast("int").alias("group"), F.lit(LOWEST).alias("kth"))
    queries = materialize(queries)
    best, done, worst = None, np.zeros((len(cells.groups), len(centres)), bool), np.full(len(centres), float(LOWEST))
    for turn in range(3):
        if turn == 0:
            now = np.zeros_like(done)
            now[cells.band, np.arange(len(centres))] = True
            now[:, cells.n == 0] = False
        else:
            now = open_pairs(cells, worst, done, PROMISING if turn == 1 else None)
        done |= now
        pairs = [(b, c, int(cells.groups[b]), int(blocks[c])) for b, c in np.argwhere(now).tolist()]
        if not pairs:
            continue
        # bounded by the square of CELLS
        pairs = F.broadcast(spark.createDataFrame(pairs, "band int, cell int, groups int, blocks int"))
        p = placed.join(pairs, "cell").select("row", "vec_id", "v", "cell", "band", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
        q = queries.join(pairs.drop("groups"), "band").select("row", "v", "kth", "band", "group", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        hits = found(q, p, k, width)
        ranks = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
        both = hits if best is None else hits.unionByName(best.select("qrow", "vec_id", "score"))
        best = materialize(both.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k))
        if turn < 2:
            kth = best.where(F.col("rank") == k).select("qrow", F.col("score").alias("s"))
            queries = queries.join(kth, F.col("row") == F.col("qrow"), "left").withColumn("kth", F.coalesce("s", F.lit(LOWEST))).drop("qrow", "s")
            queries = materialize(queries)
            for r in queries.groupBy("own").agg(F.min("kth").alias("w")).collect():  # one row a cell
                worst[r.own] = float(r.w)
    if best is None:
        return placed.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    names = queries.select(F.col("row").alias("nrow"), "query_id")
    return best.join(names, F.col("qrow") == F.col("nrow")).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.n <> b.n
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
