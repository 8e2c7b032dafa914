"""Functionals of the observed distribution: a small algebra, simplified and compiled to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causelake.errors import EstimationError
from causelake.operators.reduce import cpt


@dataclass(frozen=True)
class P:
    """P(of | given) of the observed data."""

    of: tuple[str, ...]
    given: tuple[str, ...] = ()


@dataclass(frozen=True)
class Product:
    factors: tuple


@dataclass(frozen=True)
class SumOut:
    over: tuple[str, ...]
    inner: object


@dataclass(frozen=True)
class Ratio:
    over: object
    under: object


ONE = Product(())


def free(e) -> set[str]:
    """Variables the value of an expression depends on."""
    if isinstance(e, P):
        return set(e.of) | set(e.given)
    if isinstance(e, Product):
        return set().union(*map(free, e.factors)) if e.factors else set()
    if isinstance(e, SumOut):
        return free(e.inner) - set(e.over)
    return free(e.over) | free(e.under)


def simplify(e):
    """Rewrites to a fixpoint: flat products, merged sums, sums moved inside, sums of a whole factor dropped."""
    while True:
        new = _rewrite(e)
        if new == e:
            return e
        e = new


def _rewrite(e):
    if isinstance(e, P):
        given = tuple(sorted(set(e.given) - set(e.of)))
        return ONE if not e.of else P(tuple(sorted(e.of)), given)
    if isinstance(e, Product):
        flat = []
        for f in map(_rewrite, e.factors):
            flat += f.factors if isinstance(f, Product) else [f]
        return flat[0] if len(flat) == 1 else Product(tuple(flat))
    if isinstance(e, Ratio):
        a, b = _rewrite(e.over), _rewrite(e.under)
        if b == ONE:
            return a
        if isinstance(a, P) and isinstance(b, P) and not set(a.given) ^ set(b.given) and set(b.of) < set(a.of):
            return P(tuple(sorted(set(a.of) - set(b.of))), tuple(sorted(set(a.given) | set(b.of))))
        return Ratio(a, b)
    inner, over = _rewrite(e.inner), set(e.over)
    if isinstance(inner, SumOut):
        return SumOut(tuple(sorted(over | set(inner.over))), inner.inner)
    over &= free(inner)
    if not over:
        return inner
    if isinstance(inner, P):
        if over <= set(inner.of):  # a distribution's own variables sum to one
            return _rewrite(P(tuple(set(inner.of) - over), inner.given))
        return SumOut(tuple(sorted(over)), inner)
    if isinstance(inner, Product):
        for v in sorted(over):
            holds = [f for f in inner.factors if v in free(f)]
            if len(holds) < len(inner.factors) and len(holds) == 1 and isinstance(holds[0], P) and v in holds[0].of:
                rest = tuple(f for f in inner.factors if f is not holds[0])
                return SumOut(tuple(sorted(over)), Product((*rest, SumOut((v,), holds[0]))))
        outside = tuple(f for f in inner.factors if not free(f) & over)
        if outside:
            inside = tuple(f for f in inner.factors if free(f) & over)
            return Product((*outside, SumOut(tuple(sorted(over)), Product(inside))))
    return SumOut(tuple(sorted(over)), inner)


def text(e) -> str:
    """The functional in plain notation."""
    if isinstance(e, P):
        return f"P({','.join(e.of)}{'|' + ','.join(e.given) if e.given else ''})"
    if isinstance(e, Product):
        return " ".join(map(text, e.factors)) or "1"
    if isinstance(e, SumOut):
        return f"sum_{{{','.join(e.over)}}}[{text(e.inner)}]"
    return f"({text(e.over)})/({text(e.under)})"


def latex(e) -> str:
    if isinstance(e, P):
        bar = r" \mid " + ",".join(e.given) if e.given else ""
        return f"P({','.join(e.of)}{bar})"
    if isinstance(e, Product):
        return r"\, ".join(map(latex, e.factors)) or "1"
    if isinstance(e, SumOut):
        return rf"\sum_{{{','.join(e.over)}}} {latex(e.inner)}"
    return rf"\frac{{{latex(e.over)}}}{{{latex(e.under)}}}"


def compile_frame(e, df: DataFrame) -> tuple[DataFrame, list[str]]:
    """(rows of the free variables with ``p``, these variables): products are joins, sums are aggregates.

    Conditional tables are aggregates of the data, so what is joined grows with levels, not rows.
    """
    if isinstance(e, P):
        return cpt(df, e.of, e.given), [*e.given, *e.of]
    if isinstance(e, Product):
        if not e.factors:
            return df.sparkSession.createDataFrame([(1.0,)], "p double"), []

        def join(a, b):
            (x, xv), (y, yv) = a, b
            shared = [v for v in xv if v in yv]
            y = y.withColumnRenamed("p", "__q")
            z = x.join(y, shared) if shared else x.crossJoin(y)  # factors without a shared variable: tables of levels
            names = list(dict.fromkeys([*xv, *yv]))
            return z.select(*names, (F.col("p") * F.col("__q")).alias("p")), names

        return fold(join, [compile_frame(f, df) for f in e.factors])
    if isinstance(e, SumOut):
        x, names = compile_frame(e.inner, df)
        rest = [n for n in names if n not in e.over]
        return x.groupBy(*rest).agg(F.sum("p").alias("p")), rest
    x, xv = compile_frame(e.over, df)
    y, yv = compile_frame(e.under, df)
    if set(yv) - set(xv):
        raise EstimationError("a ratio's denominator has variables of its own")
    z = x.join(y.withColumnRenamed("p", "__q"), list(yv)) if yv else x.crossJoin(y.withColumnRenamed("p", "__q"))
    return z.select(*xv, (F.col("p") / F.col("__q")).alias("p")), xv


def expectation(e, df: DataFrame, outcome: str, bind: dict[str, object]) -> DataFrame:
    """One row ``value``: the mean of ``outcome`` under the functional at the bound levels."""
    x, _ = compile_frame(e, df)
    for k, v in bind.items():
        x = x.where(F.col(k) == F.lit(v))
    return x.agg((F.sum(F.col(outcome).cast("double") * F.col("p")) / F.sum("p")).alias("value"))


def contrast(e, df: DataFrame, outcome: str, treatment: str, active, control, strict: bool = False) -> DataFrame:
    """One row ``value``: the difference of the means at two levels, from one compiled frame.

    Where cells are missing the functional's mass at a level falls below one; ``strict`` then raises,
    else the mean is over the supported mass.
    """
    x, _ = compile_frame(e, df)

    def mean(level):
        here = F.col(treatment) == F.lit(level)
        mass = F.sum(F.when(here, F.col("p")))
        value = F.sum(F.when(here, F.col(outcome).cast("double") * F.col("p"))) / mass
        if not strict:
            return value
        return F.when(F.coalesce(F.abs(mass - 1) < 1e-6, F.lit(False)), value).otherwise(F.raise_error(F.lit(f"no support for {treatment} = {level} in some cells")).cast("double"))

    return x.agg((mean(active) - mean(control)).alias("value"))


def path_contrast(e: SumOut, df: DataFrame, outcome: str, treatment: str, through, active, control) -> DataFrame:
    """One row ``value``: the nested mean with the active level in the chosen children's factors, less the mean under control."""

    def mean(levels: dict[str, object]) -> DataFrame:
        tables = []
        for f in e.inner.factors:
            table, names = compile_frame(f, df)
            if treatment in names:
                table = table.where(F.col(treatment) == F.lit(levels[f.of[0]])).drop(treatment)
                names = [n for n in names if n != treatment]
            tables.append((table, names))

        def join(a, b):
            (x, xv), (y, yv) = a, b
            shared = [v for v in xv if v in yv]
            y = y.withColumnRenamed("p", "__q")
            z = x.join(y, shared) if shared else x.crossJoin(y)  # tables of levels
            return z.select(*dict.fromkeys([*xv, *yv]), (F.col("p") * F.col("__q")).alias("p")), list(dict.fromkeys([*xv, *yv]))

        x, _ = fold(join, tables)
        return x.agg((F.sum(F.col(outcome).cast("double") * F.col("p")) / F.sum("p")).alias("v"))

    children = [f.of[0] for f in e.inner.factors]
    on = mean({c: active if c in through else control for c in children}).withColumnRenamed("v", "a")
    off = mean(dict.fromkeys(children, control)).withColumnRenamed("v", "b")
    return on.crossJoin(off).select((F.col("a") - F.col("b")).alias("value"))  # one row each


def schedule_contrast(e, df: DataFrame, outcome: str, active: dict[str, object], control: dict[str, object]) -> DataFrame:
    """One row ``value``: the mean with every scheduled treatment at its active level, less that at the control levels.

    Both sides come from one compiled frame; a side whose cells do not hold all the mass raises.
    """
    x, names = compile_frame(e, df)

    def mean(levels: dict[str, object]):
        here = F.lit(True)
        for t, v in levels.items():
            here = here & (F.col(t) == F.lit(v)) if t in names else here  # a treatment the functional does not depend on
        mass = F.sum(F.when(here, F.col("p")))
        value = F.sum(F.when(here, F.col(outcome).cast("double") * F.col("p"))) / mass
        return F.when(F.coalesce(F.abs(mass - 1) < 1e-6, F.lit(False)), value).otherwise(F.raise_error(F.lit("no support for a level of the schedule in some cells")).cast("double"))

    return x.agg((mean(active) - mean(control)).alias("value"))
