"""Pieces of SQL that several checks are made of: each gives a list of common table expressions."""

from __future__ import annotations


def regression(name: str, source: str, target: str, columns: list[str], key: str = "series_id") -> list[str]:
    """Least squares by successive projections: after `name`_k the target and the later columns are free of the first k
    columns. Rows with a missing value don't count. `name` (key, n, k, sse, after_first, total): the squared sums of
    the residuals, of the target freed of the first column, and of the target."""
    m = len(columns)
    every = ", ".join(f"CAST({c} AS DOUBLE) AS v{j}" for j, c in enumerate([target, *columns]))
    whole = " AND ".join(f"v{j} IS NOT NULL" for j in range(m + 1))
    steps = [f"{name}_0 AS (SELECT * FROM (SELECT {key}, {every} FROM {source}) WHERE {whole})"]
    for k in range(1, m + 1):
        left = [0, *range(k + 1, m + 1)]
        freed = ", ".join(f"v{j} - v{k} * (sum(v{j} * v{k}) OVER w / sum(v{k} * v{k}) OVER w) AS v{j}" for j in left)
        steps.append(f"{name}_{k} AS (SELECT {key}, {freed} FROM {name}_{k - 1} WINDOW w AS (PARTITION BY {key}))")
    sums = lambda k, c: f"(SELECT {key}, count(*) AS n, sum(v0 * v0) AS {c} FROM {name}_{k} GROUP BY 1)"
    steps.append(f"{name} AS (SELECT a.{key}, a.n, {m} AS k, sse, after_first, total FROM {sums(m, 'sse')} a JOIN {sums(1, 'after_first')} b USING ({key}) JOIN {sums(0, 'total')} c USING ({key}))")
    return steps


def arch(name: str, source: str, column: str, lags: int) -> list[str]:
    """n R2 of a column's square on its lags: `name` (series_id, stat)."""
    sq = f"({column} * {column})"
    lagged = ", ".join(f"lag({sq}, {k}) OVER (PARTITION BY series_id ORDER BY date) AS x{k}" for k in range(1, lags + 1))
    parts = [f"{name}_l AS (SELECT series_id, {sq} AS y, 1.0 AS one, {lagged} FROM {source})"]
    parts += regression(f"{name}_r", f"{name}_l", "y", ["one", *(f"x{k}" for k in range(1, lags + 1))])
    return [*parts, f"{name} AS (SELECT series_id, n * (1 - sse / after_first) AS stat FROM {name}_r)"]


def box(name: str, source: str, column: str, lags: int) -> list[str]:
    """Ljung-Box of a column: `name` (series_id, stat)."""
    lagged = ", ".join(f"lag(x, {k}) OVER (PARTITION BY series_id ORDER BY date) AS x{k}" for k in range(1, lags + 1))
    q = " + ".join(f"pow(sum(x * x{k}) / sum(x * x), 2) / (count(*) - {k})" for k in range(1, lags + 1))
    return [
        f"{name}_c AS (SELECT series_id, date, {column} - avg({column}) OVER (PARTITION BY series_id) AS x FROM {source})",
        f"{name}_l AS (SELECT series_id, x, {lagged} FROM {name}_c)",
        f"{name} AS (SELECT series_id, count(*) * (count(*) + 2) * ({q}) AS stat FROM {name}_l GROUP BY 1)",
    ]


def sign_bias(name: str, source: str, z: str, eps: str) -> list[str]:
    last = f"lag({eps}) OVER (PARTITION BY series_id ORDER BY date)"
    parts = [
        f"{name}_l AS (SELECT series_id, {z} * {z} AS y, 1.0 AS one, {last} AS e FROM {source})",
        f"{name}_x AS (SELECT *, CASE WHEN e < 0 THEN 1.0 ELSE 0.0 END AS neg, CASE WHEN e < 0 THEN e ELSE 0.0 END AS low, CASE WHEN e < 0 THEN 0.0 ELSE e END AS high FROM {name}_l WHERE e IS NOT NULL)",
    ]
    parts += regression(f"{name}_r", f"{name}_x", "y", ["one", "neg", "low", "high"])
    return [*parts, f"{name} AS (SELECT series_id, n * (1 - sse / after_first) AS stat FROM {name}_r)"]


def breaks(name: str, source: str, column: str, critical: float = 1.358, least: int = 30) -> list[str]:
    """The iterated cumulative sums of squares: segments (lo, hi] and their largest deviation, split while it is beyond
    `critical`. `name` (series_id, loc): the last row, from 1, before each break."""
    best = f"""SELECT s.series_id, s.lo, s.hi, arg_max(c.i, (abs((c.c - a.c) / (b.c - a.c) - (c.i - s.lo) / CAST(s.hi - s.lo AS DOUBLE)))) AS loc,
      max(sqrt((s.hi - s.lo) / 2.0) * abs((c.c - a.c) / (b.c - a.c) - (c.i - s.lo) / CAST(s.hi - s.lo AS DOUBLE))) AS stat
    FROM {{segments}} s JOIN {name}_c a ON a.series_id = s.series_id AND a.i = s.lo JOIN {name}_c b ON b.series_id = s.series_id AND b.i = s.hi
      JOIN {name}_c c ON c.series_id = s.series_id AND c.i > s.lo AND c.i < s.hi WHERE s.hi - s.lo >= {least} AND b.c > a.c GROUP BY 1, 2, 3"""
    split = f"stat > {critical} AND loc - lo >= {least // 2} AND hi - loc >= {least // 2}"
    return [
        f"{name}_c AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i, sum({column} * {column}) OVER (PARTITION BY series_id ORDER BY date) AS c FROM {source} UNION ALL SELECT DISTINCT series_id, 0, 0.0 FROM {source})",
        f"{name}_s AS (SELECT series_id, CAST(0 AS BIGINT) AS lo, max(i) AS hi FROM {name}_c GROUP BY 1 UNION ALL SELECT series_id, CASE side WHEN 0 THEN lo ELSE loc END, CASE side WHEN 0 THEN loc ELSE hi END FROM ({best.format(segments=f'{name}_s')}), (SELECT unnest([0, 1]) AS side) WHERE {split})",
        f"{name} AS (SELECT series_id, loc FROM ({best.format(segments=f'{name}_s')}) WHERE {split})",
    ]
