"""Statistical roles and value kinds as Spark field metadata."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causelake.errors import DataError

KINDS = ("continuous", "count", "binary", "categorical", "ordinal", "vector")
ROLES = ("treatment", "outcome", "covariate", "mediator", "instrument", "selection", "unit", "time", "environment")

MASK, WEIGHT, UNIT, TIME, ENVIRONMENT = "__mask", "__w", "__unit", "__t", "__env"


@dataclass(frozen=True)
class Variable:
    name: str
    kind: str = "continuous"
    roles: tuple[str, ...] = ()
    unit: str | None = None
    levels: tuple = ()

    def __post_init__(self):
        if self.kind not in KINDS or set(self.roles) - set(ROLES):
            raise DataError(f"unknown kind or role of {self.name}")


def declare(df: DataFrame, variables: Sequence[Variable]) -> DataFrame:
    """Checks names once and puts the declarations into field metadata."""
    names = [v.name for v in variables]
    if len(set(names)) != len(names) or set(names) - set(df.columns):
        raise DataError("variable names must be unique and present")
    by = {v.name: v for v in variables}
    meta = lambda v: {"value_kind": v.kind, "roles": list(v.roles), "unit": v.unit or "", "levels": [str(x) for x in v.levels]}
    return df.select(*[F.col(c).alias(c, metadata=meta(by[c])) if c in by else F.col(c) for c in df.columns])


def declared(df: DataFrame) -> dict[str, Variable]:
    return {
        f.name: Variable(f.name, f.metadata["value_kind"], tuple(f.metadata["roles"]), f.metadata["unit"] or None, tuple(f.metadata["levels"]))
        for f in df.schema
        if "value_kind" in f.metadata
    }


def valid(df: DataFrame, columns: Sequence[str]) -> Column:
    """Complete-case predicate of the used columns and the analysis mask: null is missing, NaN is a value."""
    keep = F.col(MASK) if MASK in df.columns else F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull()
    return keep


def complete_cases(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The rows whose named columns are all present, with only these columns (and the weight, if any)."""
    names = list(dict.fromkeys([*columns, *keep, *([WEIGHT] if WEIGHT in df.columns else [])]))
    return df.where(valid(df, columns)).select(*names)


def with_mask(df: DataFrame, mask: Column) -> DataFrame:
    return df.withColumn(MASK, F.coalesce(mask, F.lit(False)))


def with_weight(df: DataFrame, weight: Column) -> DataFrame:
    """Row weights; a negative or non-finite one counts as zero."""
    w = weight.cast("double")
    return df.withColumn(WEIGHT, F.when(w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf")), w).otherwise(0.0))


def population(df: DataFrame, kind: str = "all", **options) -> DataFrame:
    """The target population: all rows, listed rows, an environment, a time range, or a predicate."""
    if kind == "all":
        return df
    if kind == "rows":
        ids = options["ids"]
        ids = ids if isinstance(ids, DataFrame) else df.sparkSession.createDataFrame([(i,) for i in ids], df.select(options["key"]).schema)
        return df.join(ids, options["key"], "left_semi")
    if kind == "environment":
        return df.where(F.col(ENVIRONMENT) == options["value"])
    if kind == "time":
        return df.where((F.col(TIME) >= options["start"]) & (F.col(TIME) < options["end"]))
    if kind == "predicate":
        return df.where(options["where"])
    raise DataError(f"no population {kind!r}")


def sample(df: DataFrame, columns: Sequence[str], missing: str = "complete_case", mask: str = "honor", weight: str = "honor", keep: Sequence[str] = ()) -> DataFrame:
    """The prepared sample of a declared request: used columns, missing values, mask and weights each by a named policy.

    ``missing``: ``complete_case`` drops rows with a missing used column, ``error`` refuses them.  ``mask``: ``honor`` or
    ``ignore`` the analysis mask.  ``weight``: ``honor`` the weights (1 where there are none), ``unit`` gives every row 1,
    ``ignore`` leaves the column out.
    """
    for value, known in ((missing, ("complete_case", "error")), (mask, ("honor", "ignore")), (weight, ("honor", "unit", "ignore"))):
        if value not in known:
            raise DataError(f"no policy {value!r}")
    rows = df.where(F.coalesce(F.col(MASK), F.lit(False))) if mask == "honor" and MASK in df.columns else df
    if missing == "error":
        holes = rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"h{i}") for i, c in enumerate(columns)]).first()
        found = [c for i, c in enumerate(columns) if holes[f"h{i}"]]
        if found:
            raise DataError(f"missing values in {', '.join(found)}")
    else:
        for c in columns:
            rows = rows.where(F.col(c).isNotNull())
    names = [F.col(c) for c in dict.fromkeys([*columns, *keep])]
    if weight != "ignore":
        names.append(F.col(WEIGHT) if weight == "honor" and WEIGHT in df.columns else F.lit(1.0).alias(WEIGHT))
    return rows.select(*names)
