"""Tables and Markdown from small results, plot data instead of pictures, and a gate of diagnostics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A table of a small result; longer ones are cut with a note."""
    rows = df.limit(most + 1).collect()
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(show(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + (["", f"(first {most} rows)"] if len(rows) > most else [])) + "\n"


def html(df: DataFrame, title: str, most: int = 200) -> str:
    """The same as HTML; longer results are cut with a note."""
    from html import escape

    rows = df.limit(most + 1).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows[:most])
    note = f"<p>(first {most} rows)</p>" if len(rows) > most else ""
    return f"<h2>{escape(title)}</h2><table><tr>{head}</tr>{body}</table>{note}"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def sections(title: str, parts: dict[str, DataFrame | str], as_html: bool = False) -> str:
    """A report: sections of text and of small tables."""
    lines = [f"<h1>{title}</h1>" if as_html else f"# {title}\n"]
    for name, part in parts.items():
        if isinstance(part, str):
            lines.append(f"<h2>{name}</h2><p>{part}</p>" if as_html else f"## {name}\n\n{part}\n")
        else:
            lines.append(html(part, name) if as_html else markdown(part, name))
    return "\n".join(lines)


def backtest_report(metrics: DataFrame, benchmarks: DataFrame, quintiles: DataFrame, regression: DataFrame, flags: DataFrame, costs: DataFrame, as_html: bool = False) -> str:
    """The signal's backtest: is it paid for, against what, at what cost, and why not."""
    return sections("Signal backtest", {"Performance": metrics, "Benchmarks": benchmarks, "Forward returns by quintile": quintiles, "Predictive regression": regression, "Cost sensitivity": costs, "Reasons not to run it": flags}, as_html)


def risk_report(fits: DataFrame, var_es: DataFrame, comparison: DataFrame, verdicts: DataFrame, as_html: bool = False) -> str:
    """Filtered historical simulation: fits, VaR and ES, and how the models did."""
    return sections("Value at risk", {"Fits": fits, "VaR and ES": var_es, "Against the plain models": comparison, "Backtests": verdicts}, as_html)


def regime_report_text(report: DataFrame, stats: DataFrame, matrix: DataFrame, as_html: bool = False) -> str:
    note = "States are declared on filtered probabilities, which know nothing later; smoothed ones look ahead and are for inspection only."
    return sections("Volatility regimes", {"Look-ahead": note, "Regimes": report, "Transitions": matrix, "Episodes and friction": stats}, as_html)


def overlay_report(metrics: DataFrame, grid: DataFrame, episodes: DataFrame, as_html: bool = False) -> str:
    return sections("Exposure overlay", {"Books": metrics, "Sensitivity (Sharpe by kappa and target)": grid, "Episodes": episodes}, as_html)


def diagnostics_report(verdicts: DataFrame, as_html: bool = False) -> str:
    """All verdict rows, and which of them forbid the model."""
    failed = blocking(verdicts)
    codes = ", ".join(sorted({r.code for r in failed.limit(200).collect()}))
    return sections("Econometric diagnostics", {"Tests": verdicts, "Verdict": f"Blocking: {codes}. Do not use this model." if codes else "No blocking failure."}, as_html)


def plot_data(df: DataFrame, x: str, ys: list[str], points: int | None = None) -> DataFrame:
    """(x, series, y) for a chart, every row; with `points`, each line thinned to about so many by its row's place."""
    from pyspark.sql import Window

    stacked = df.select(F.col(x).alias("x"), F.explode(F.array(*[F.struct(F.lit(y).alias("series"), F.col(y).cast("double").alias("y")) for y in ys])).alias("e")).select("x", "e.*")
    if points is None:
        return stacked
    ranked = stacked.withColumn("i", F.row_number().over(Window.partitionBy("series").orderBy("x")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("series")))
    return ranked.where(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / points)) == 0).select("x", "series", "y")


class DiagnosticFailure(RuntimeError):
    pass


def blocking(verdicts: DataFrame, codes: tuple[str, ...] = ("A1.joint", "B1", "B2", "B3", "B5", "B6")) -> DataFrame:
    """verdicts (code, status): the failed rows whose code starts with one of `codes`; of A1 only the joint one."""
    hit = F.lit(False)
    for c in codes:
        hit = hit | F.col("code").startswith(c)
    return verdicts.where(hit & (F.col("status") == "FAIL"))


def check_verdicts(verdicts: DataFrame) -> None:
    failed = [r.code for r in blocking(verdicts).limit(20).collect()]
    if failed:
        raise DiagnosticFailure(", ".join(failed))


@contextmanager
def gate(before: DataFrame | None = None) -> Iterator[dict[str, DataFrame]]:
    """Verdicts of the input are checked on entry; the block puts the fitted model's into the bag's `after`, which is
    checked on exit."""
    if before is not None:
        check_verdicts(before)
    bag: dict[str, DataFrame] = {}
    yield bag
    if "after" not in bag:
        raise DiagnosticFailure("the block left no verdicts of its model")
    check_verdicts(bag["after"])


def gated(before: Callable[..., DataFrame] | None = None, after: Callable[..., DataFrame] | None = None):
    """Decorator: run diagnostics on a model's input and on its result; a blocking failure raises."""

    def wrap(model):
        @wraps(model)
        def run(data: DataFrame, *args, **kwargs) -> DataFrame:
            if before:
                check_verdicts(before(data))
            out = model(data, *args, **kwargs)
            if after:
                check_verdicts(after(out))
            return out

        return run

    return wrap
