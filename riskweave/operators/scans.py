"""Recursive filters and state machines as scans: one series runs on many tasks.

A step whose state enters it affinely, linearly or through a finite table is a map from state to state, and maps
compose. A series is cut into chunks of time; every chunk's rows are composed into one map, the maps are composed along
the series in two levels (`FAN` chunks, then the rest), and each chunk is replayed from its true first state. All of it
is SQL expressions over arrays, written as text; a chunk's rows, a series' maps and `FAN` maps are what a task holds.

Defined cases, for all filters here: a row without its input leaves the state as it is; rows without a date come last;
rows that tie in date are taken in order of their columns; a null key is a series of its own; other columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written

#: Days of a chunk. A daily series has as many rows in it at most.
WIDTH = 512
#: Chunks whose maps are composed together.
FAN = 64
#: Rows whose results are gathered in one array before arrays are put together.
_SLICE = 128
_LAST = 1 << 40
_names = count()


def _fresh() -> str:
    return f"v{next(_names)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """`body` of a value that is computed once."""
    v = _fresh()
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def num(x: float) -> str:
    return f"({float(x)!r}D)"


def field(row: str, column: str) -> str:
    return f"{row}.`{column}`"


def struct(**fields: str) -> str:
    return "struct(" + ", ".join(f"{v} AS `{k}`" for k, v in fields.items()) + ")"


def array(items: list[str]) -> str:
    return "array(" + ", ".join(items) + ")"


def absent(x: str) -> str:
    return f"({x} IS NULL OR isnan({x}))"


@dataclass(frozen=True)
class Scan:
    """SQL of a filter. `lift` makes a row's map; `compose` joins a map and the one after it; `apply` sends a state
    through a map; `step` and `out` are the filter itself: the next state, and a struct of outputs from (state, row, next
    state)."""

    lift: Callable[[str], str]
    compose: Callable[[str, str], str]
    apply: Callable[[str, str], str]
    step: Callable[[str, str], str]
    out: Callable[[str, str, str], str]


def _composed(items: str, scan: Scan, lift: Callable[[str], str]) -> str:
    """The map of all items, in order."""
    m, x = _fresh(), _fresh()
    return f"aggregate(slice({items}, 2, greatest(size({items}) - 1, 0)), {lift(f'element_at({items}, 1)')}, ({m}, {x}) -> {let(lift(x), lambda n: scan.compose(m, n))})"


def _visited(items: str, start: str, visit: Callable[[str, str], str], kind: str) -> str:
    """The outputs of `visit`, (state, item) -> struct(state, out), along an array. Results are gathered in slices: adding
    to one long array would copy it for every row."""

    def gathered(over: str, state: str, empty: str, each: Callable[[str, str], str], out: str) -> str:
        acc, x = _fresh(), _fresh()
        body = let(each(f"{acc}.state", x), lambda r: struct(state=f"{r}.state", outs=f"concat({acc}.outs, array({r}.{out}))"))
        return f"aggregate({over}, {struct(state=state, outs=f'CAST(array() AS {empty})')}, ({acc}, {x}) -> {body})"

    k = _fresh()
    parts = f"transform(sequence(0, CAST(floor((size({items}) - 1) / {_SLICE}) AS INT)), {k} -> slice({items}, {k} * {_SLICE} + 1, {_SLICE}))"
    inner = lambda state, part: gathered(part, state, f"array<{kind}>", visit, "out")
    return f"flatten({gathered(parts, start, f'array<array<{kind}>>', inner, 'outs')}.outs)"


def chunk_of(df: DataFrame, order: str, width: int = WIDTH) -> Column:
    """Which chunk of `width` days, or of `width` steps of a number, a row is in."""
    kind = dict(df.dtypes)[order]
    c = F.col(order)
    days = F.unix_date(c) if kind == "date" else F.unix_seconds(c.cast("timestamp")) / 86400 if kind.startswith("timestamp") else c
    return F.floor(days / width).cast("long")


def run(
    df: DataFrame, scan: Scan, start: Callable[[str], str], outputs: str, keys: list[str] | None = None, order: str = "date", chunk: Column | None = None, width: int = WIDTH, backward: bool = False
) -> DataFrame:
    """Add the columns of `outputs` ("name type, ...", the fields of `scan.out`). `start` is the first state, from the
    series' first row. `chunk` may be any column that never falls along a series. `backward` runs from the last row."""
    keys = keys or ["series_id"]
    chunk = F.coalesce(chunk_of(df, order, width) if chunk is None else chunk, F.lit(_LAST))
    sort = "reverse(array_sort({}))" if backward else "array_sort({})"
    # The keys as one struct: it is never null, and joins and groups of it share their partitioning.
    rows = df.select(F.struct(*keys).alias("__key"), (-chunk if backward else chunk).alias("__chunk"), F.struct(F.col(order).alias("__order"), F.struct(*df.columns).alias("__row")).alias("__item"))
    names = [o.strip().rsplit(" ", 1) for o in outputs.split(",")]
    kind = "struct<" + ", ".join(f"`{n}`: {t}" for n, t in names) + ">"

    # Written once: the chunks are read for their maps, which are composed on two levels, and for the replay.
    chunks = written(rows.groupBy("__key", "__chunk").agg(F.expr(f"transform({sort.format('collect_list(__item)')}, x -> x.__row) AS __rows")))
    maps = chunks.selectExpr("__key", "__chunk", f"{_composed('__rows', scan, scan.lift)} AS map", "element_at(__rows, 1) AS first")
    fans = (
        maps.groupBy("__key", F.expr(f"floor(__chunk / {FAN}) AS __fan"))
        .agg(F.expr("sort_array(collect_list(struct(__chunk AS at, map, first))) AS __parts"))
        .selectExpr("__key", "__fan", "__parts", f"{_composed('__parts', scan, lambda p: f'{p}.map')} AS map")
    )
    whole = fans.groupBy("__key").agg(F.expr("sort_array(collect_list(struct(__fan AS at, map, element_at(__parts, 1).first AS first))) AS __fans"))
    whole = whole.selectExpr("__key", "__fans", f"{start('element_at(__fans, 1).first')} AS __first")

    begin = f"struct<at: bigint, state: {whole.schema['__first'].dataType.simpleString()}>"
    visit = lambda s, part: struct(state=scan.apply(f"{part}.map", s), out=struct(at=f"{part}.at", state=s))
    of_fans = whole.selectExpr("__key", f"inline({_visited('__fans', '__first', visit, begin)}) AS (__fan, __state)")
    # Hashed, not broadcast: chunks and fans stay where they are, dealt by key and number.
    of_chunks = fans.join(of_fans.hint("shuffle_hash"), ["__key", "__fan"]).selectExpr("__key", f"inline({_visited('__parts', '__state', visit, begin)}) AS (__chunk, __state)")
    replay = lambda s, row: let(scan.step(s, row), lambda n: struct(state=n, out=scan.out(s, row, n)))
    done = chunks.join(of_chunks.hint("shuffle_hash"), ["__key", "__chunk"]).selectExpr(f"inline(arrays_zip(__rows, {_visited('__rows', '__state', replay, kind)})) AS (__row, __out)")
    new = {n for n, _ in names}
    return done.selectExpr(*[f"{field('__row', c)} AS `{c}`" for c in df.columns if c not in new], *[f"{field('__out', n)} AS `{n}`" for n, _ in names])


# --- affine states -------------------------------------------------------------------------------------------


def affine(multiply: Callable[[str], str], add: Callable[[str], str], missing: Callable[[str], str], out: Callable[[str, str, str], str]) -> Scan:
    """A number s that becomes multiply(row) * s + add(row), and stays where a row is `missing`."""
    return Scan(
        lambda row: f"if({missing(row)}, {struct(a='1D', b='0D')}, {struct(a=multiply(row), b=add(row))})",
        lambda m, n: struct(a=f"{m}.a * {n}.a", b=f"{n}.a * {m}.b + {n}.b"),
        lambda m, s: f"{m}.a * {s} + {m}.b",
        lambda s, row: f"if({missing(row)}, {s}, {multiply(row)} * {s} + {add(row)})",
        out,
    )


def _volatility(state: str, row: str, after: str) -> str:
    return struct(sigma=f"sqrt({state})")


def ewma_vol(returns: DataFrame, decay: float = 0.94, first_var: float | None = None, keys: list[str] | None = None, **how) -> DataFrame:
    """Exponentially weighted volatility before each row's return. The variance starts from `first_var`, else from the
    square of the first return (zero if that is missing)."""
    ret = lambda row: field(row, "ret")
    scan = affine(lambda r: num(decay), lambda r: f"{num(1 - decay)} * {ret(r)} * {ret(r)}", lambda r: absent(ret(r)), _volatility)
    start = lambda r: num(first_var) if first_var is not None else f"if({absent(ret(r))}, 0D, {ret(r)} * {ret(r)})"
    return run(returns, scan, start, "sigma double", keys, **how)


def gjr_filter(residuals: DataFrame, omega: float, alpha: float, gamma: float, beta: float, first_var: float, column: str = "ret", **how) -> DataFrame:
    """Volatility of a GJR recursion with given parameters: the variance is affine in itself, given the residual."""
    e = lambda row: field(row, column)
    add = lambda r: f"({num(omega)} + if({e(r)} < 0, {num(alpha + gamma)}, {num(alpha)}) * {e(r)} * {e(r)})"
    scan = affine(lambda r: num(beta), add, lambda r: absent(e(r)), _volatility)
    return run(residuals, scan, lambda r: num(first_var), "sigma double", **how)


def arma_residuals(returns: DataFrame, const: float, phi: float, theta: float, column: str = "ret", **how) -> DataFrame:
    """e_t = r_t - c - phi r_{t-1} - theta e_{t-1}, the first row without lags. A chunk's map takes (r, e) to its last return
    and k + p r + q e; without a return of its own it hands r on."""
    value = lambda row: f"CAST({field(row, column)} AS DOUBLE)"
    missing = lambda row: absent(field(row, column))
    same = struct(r="CAST(NULL AS DOUBLE)", k="0D", p="0D", q="1D")
    own = lambda row: struct(r=value(row), k=f"{value(row)} - {num(const)}", p=num(-phi), q=num(-theta))
    compose = lambda m, n: struct(
        r=f"coalesce({n}.r, {m}.r)", k=f"{n}.k + coalesce({n}.p * {m}.r, 0D) + {n}.q * {m}.k", p=f"if({m}.r IS NULL, {n}.p, 0D) + {n}.q * {m}.p", q=f"{n}.q * {m}.q"
    )
    scan = Scan(
        lambda row: f"if({missing(row)}, {same}, {own(row)})",
        compose,
        lambda m, s: struct(r=f"coalesce({m}.r, {s}.r)", e=f"{m}.k + {m}.p * {s}.r + {m}.q * {s}.e"),
        lambda s, row: f"if({missing(row)}, {s}, {struct(r=value(row), e=f'{value(row)} - {num(const)} - {num(phi)} * {s}.r - {num(theta)} * {s}.e')})",
        lambda s, row, n: struct(eps=f"if({missing(row)}, NULL, {n}.e)"),
    )
    return run(returns, scan, lambda r: struct(r="0D", e="0D"), "eps double", **how)


# --- regime probabilities ------------------------------------------------------------------------------------


def _matrix(x: str, transition: tuple[tuple[float, ...], ...], mean: tuple[float, ...], sd: tuple[float, ...]) -> str:
    """The row-major matrix of a row: move, then weigh by the normal densities over the largest of them, so that they
    don't underflow together; the identity where the value is missing."""
    k = len(mean)
    unit = array([num(i == j) for i in range(k) for j in range(k)])
    logs = array([f"-0.5D * pow(({x} - {num(m)}) / {num(s)}, 2) - ln({num(s)})" for m, s in zip(mean, sd)])
    e = _fresh()
    density = lambda v: f"transform({v}, {e} -> exp({e} - array_max({v})))"
    moved = let(let(logs, density), lambda d: array([f"{num(transition[i][j])} * {d}[{j}]" for i in range(k) for j in range(k)]))
    return f"if({absent(x)}, {unit}, {moved})"


def _scaled(cells: list[str]) -> str:
    """An array over its sum, so that long products neither vanish nor overflow. All cells are nonnegative."""
    e = _fresh()
    total = lambda v: " + ".join(f"{v}[{j}]" for j in range(len(cells)))
    return let(array(cells), lambda v: let(total(v), lambda t: f"transform({v}, {e} -> try_divide({e}, {t}))"))


def _product(a: str, b: str, k: int) -> str:
    return _scaled([" + ".join(f"{a}[{i * k + m}] * {b}[{m * k + j}]" for m in range(k)) for i in range(k) for j in range(k)])


def _row_times(v: str, m: str, k: int) -> str:
    return _scaled([" + ".join(f"{v}[{i}] * {m}[{i * k + j}]" for i in range(k)) for j in range(k)])


def _times_column(m: str, v: str, k: int) -> str:
    return _scaled([" + ".join(f"{m}[{i * k + j}] * {v}[{j}]" for j in range(k)) for i in range(k)])


def hamilton_states(df: DataFrame, column: str, transition: tuple[tuple[float, ...], ...], mean: tuple[float, ...], sd: tuple[float, ...], names: tuple[str, ...], first: tuple[float, ...] | None = None, **how) -> DataFrame:
    """Filtered probabilities of a Markov chain with normal observations, one column a state. The chain starts from
    `first` before the first row, else from equal shares. A row's map is the transition matrix weighed by the densities;
    maps compose as scaled matrix products."""
    k = len(mean)
    matrix = lambda row: _matrix(f"CAST({field(row, column)} AS DOUBLE)", transition, mean, sd)
    scan = Scan(
        matrix,
        lambda m, n: _product(m, n, k),
        lambda m, s: _row_times(s, m, k),
        lambda s, row: let(matrix(row), lambda m: _row_times(s, m, k)),
        lambda s, row, n: struct(**{name: f"{n}[{j}]" for j, name in enumerate(names)}),
    )
    return run(df, scan, lambda r: array([num(p) for p in first or (1 / k,) * k]), ", ".join(f"{n} double" for n in names), **how)


def stationary(stay: tuple[float, float]) -> tuple[float, float]:
    stress = (1 - stay[0]) / (2 - stay[0] - stay[1])
    return 1 - stress, stress


def hamilton_filter(df: DataFrame, column: str, stay: tuple[float, float], mean: tuple[float, float], sd: tuple[float, float], **how) -> DataFrame:
    """Filtered probability of the second of two states, from the chain's stationary shares."""
    two = (stay[0], 1 - stay[0]), (1 - stay[1], stay[1])
    return hamilton_states(df, column, two, mean, sd, ("__calm", "p_stress"), stationary(stay), **how).drop("__calm")


def kim_smoother(df: DataFrame, column: str, transition: tuple[tuple[float, ...], ...], mean: tuple[float, ...], sd: tuple[float, ...], names: tuple[str, ...], first: tuple[float, ...] | None = None, **how) -> DataFrame:
    """Probabilities given the whole series, one column a state: the filtered ones times what the rows after say, which a
    second scan carries backward with the same matrices."""
    k = len(mean)
    filtered = hamilton_states(df, column, transition, mean, sd, tuple(f"__f{j}" for j in range(k)), first, **how)
    matrix = lambda row: _matrix(f"CAST({field(row, column)} AS DOUBLE)", transition, mean, sd)
    scan = Scan(
        matrix,
        lambda m, n: _product(n, m, k),
        lambda m, s: _times_column(m, s, k),
        lambda s, row: let(matrix(row), lambda m: _times_column(m, s, k)),
        lambda s, row, n: let(_scaled([f"{field(row, f'__f{j}')} * {s}[{j}]" for j in range(k)]), lambda p: struct(**{name: f"{p}[{j}]" for j, name in enumerate(names)})),
    )
    smooth = run(filtered, scan, lambda r: array(["1D"] * k), ", ".join(f"{n} double" for n in names), backward=True, **how)
    return smooth.drop(*[f"__f{j}" for j in range(k)])


# --- a state machine -----------------------------------------------------------------------------------------


def _machine(confirm: int, dwell: int) -> tuple[int, list[int], list[bool]]:
    """(states, next state, whether it turned) for each of the symbols none, above, below and each state. A state is
    stressed or not, days in it up to `dwell`, and the run of days above (positive) or below (negative) up to `confirm`."""
    codes = [(s, d, r) for s in (False, True) for d in range(dwell + 1) for r in range(-confirm, confirm + 1)]
    place = {c: k for k, c in enumerate(codes)}
    following, turns = [], []
    for symbol in (0, 1, -1):
        for stressed, days, streak in codes:
            streak = 0 if symbol == 0 else symbol * min(confirm, 1 + max(0, symbol * streak))
            turn = streak == (-confirm if stressed else confirm) and days >= dwell
            following.append(place[stressed != turn, min(dwell, 1 if turn else days + 1), streak])
            turns.append(turn)
    return len(codes), following, turns


def anti_chattering(
    df: DataFrame, p: str = "p_stress", confirms: str = "confirms", enter: float = 0.7, leave: float = 0.3, confirm: int = 2, dwell: int = 5, partial: float = 0.5, **how
) -> DataFrame:
    """Two-threshold regime with confirmation and dwell: it turns after `confirm` days in a row beyond the other
    threshold, if it has lasted `dwell` days. Without an exogenous confirmation stress counts at `partial`. Adds stressed,
    days_in and derisk. A missing probability is an error.

    Counters matter only up to `confirm` and `dwell`, so the states are few and a chunk is a table: for each state the
    one it leads to and the days since it turned within the chunk (0: it didn't)."""
    if leave > enter:
        raise ValueError("the thresholds overlap")
    size, following, turns = _machine(confirm, dwell)
    # By symbol and state: 2 * next state + whether it turned.
    table = array([str(2 * f + t) for f, t in zip(following, turns)])

    def symbol(row: str) -> str:
        x = field(row, p)
        return f"CASE WHEN {absent(x)} THEN CAST(raise_error('a regime probability is missing') AS INT) WHEN {x} > {num(enter)} THEN 1 WHEN {x} < {num(leave)} THEN 2 ELSE 0 END"

    # A map: n, its rows, and for each state `since * size + state`.
    def lift(row: str) -> str:
        e = _fresh()
        entry = lambda t: f"CAST(if({t} % 2 = 1, {size}, 0) + {t} DIV 2 AS BIGINT)"
        ends = let(symbol(row), lambda sign: f"transform(slice({table}, {sign} * {size} + 1, {size}), {e} -> {entry(e)})")
        return struct(n="1L", ends=ends)

    def compose(m: str, n: str) -> str:
        e = _fresh()
        entry = lambda t: f"if({t} >= {size}, {t}, if({e} >= {size}, {e} DIV {size} + {n}.n, 0) * {size} + {t})"
        through = let(f"element_at({n}.ends, CAST({e} % {size} AS INT) + 1)", entry)
        return struct(n=f"{m}.n + {n}.n", ends=f"transform({m}.ends, {e} -> {through})")

    at = lambda code, days: struct(code=f"CAST({code} AS BIGINT)", days=f"CAST({days} AS BIGINT)")
    stressed = lambda n: f"({n}.code >= {size // 2})"
    scan = Scan(
        lift,
        compose,
        lambda m, s: let(f"element_at({m}.ends, CAST({s}.code AS INT) + 1)", lambda t: at(f"{t} % {size}", f"if({t} >= {size}, {t} DIV {size}, {s}.days + {m}.n)")),
        lambda s, row: let(f"element_at({table}, CAST(({symbol(row)}) * {size} + {s}.code AS INT) + 1)", lambda t: at(f"{t} DIV 2", f"if({t} % 2 = 1, 1, {s}.days + 1)")),
        lambda s, row, n: struct(stressed=stressed(n), days_in=f"CAST({n}.days AS INT)", derisk=f"CASE WHEN NOT {stressed(n)} THEN 0D WHEN {field(row, confirms)} THEN 1D ELSE {num(partial)} END"),
    )
    calm = dwell * (2 * confirm + 1) + confirm
    return run(df, scan, lambda r: at(str(calm), str(dwell)), "stressed boolean, days_in int, derisk double", **how)
