"""NULL / NaN / IEEE rules of the analysis as built-in Column expressions.

All helpers return plain ``Column`` objects, so they stay inside whole-stage
codegen and run on the executors; none of them is a Python UDF.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sql_str(v) -> str:
    """A Python string as an SQL string literal."""
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(name: str) -> str:
    """A column name as an SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def drop_nan(x) -> Column:
    """NaN becomes NULL; other values (Inf included) pass through."""
    return F.nanvl(_c(x).cast("double"), F.lit(None).cast("double"))


def sum_na_rm_sql(x: str) -> str:
    """SQL text of ``sum_na_rm`` over an SQL expression."""
    return f"coalesce(sum(nanvl(CAST({x} AS DOUBLE), CAST(NULL AS DOUBLE))), 0D)"


def sum_na_rm(x) -> Column:
    """Aggregate: sum skipping NULL and NaN; an empty or all-missing group gives 0."""
    if isinstance(x, str):
        return F.expr(sum_na_rm_sql(sql_name(x)))
    return F.coalesce(F.sum(drop_nan(x)), F.lit(0.0))


def strict_sum_sql(x: str, when: str | None = None) -> str:
    """SQL text of ``strict_sum`` over a column name (and an SQL predicate)."""
    if when is None:
        return f"CASE WHEN count({x}) = count(1) THEN sum({x}) END"
    v = f"CASE WHEN {when} THEN {x} END"
    return f"CASE WHEN count({v}) = count(CASE WHEN {when} THEN 1 END) THEN sum({v}) END"


def strict_sum(x, when: Column | str | None = None) -> Column:
    """Aggregate: sum that any NULL poisons; NaN propagates; no rows gives NULL.

    With ``when``, only rows where the predicate holds take part (conditional
    aggregate used by the one-shuffle pivots). Given a column name and an SQL
    predicate, the expression is built as SQL text in one call, which keeps
    plans with dozens of such aggregates cheap to build.
    """
    if isinstance(x, str) and (when is None or isinstance(when, str)):
        return F.expr(strict_sum_sql(f"`{x}`", when))
    x = _c(x)
    if when is None:
        return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))
    v = F.when(when, x)
    return F.when(F.count(v) == F.count(F.when(when, F.lit(1))), F.sum(v))


def present(when: Column | str) -> Column:
    """Aggregate: true when at least one row satisfies ``when``."""
    if isinstance(when, str):
        return F.expr(f"count(CASE WHEN {when} THEN 1 END) > 0")
    return F.count(F.when(when, F.lit(1))) > 0


def ieee_div(a, b) -> Column:
    """IEEE division: x/0 is +-Inf, 0/0 and NaN/0 are NaN, NULL stays NULL.

    ANSI mode raises on a zero divisor, so the zero case is written out.
    """
    a, b = _c(a), _c(b)
    return F.when(b == 0, a.cast("double") * F.lit(INF)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def not_in_null_safe(x, values) -> Column:
    """Predicate ``NOT (x IN values)`` that keeps NULL (R's ``!(x %in% v)``)."""
    return ~F.coalesce(_c(x).isin(list(values)), F.lit(False))


def is_missing(x) -> Column:
    """NULL or NaN (what complete-case filtering treats as missing)."""
    x = _c(x)
    return x.isNull() | F.isnan(x)


def row_sum_na_rm(cols) -> Column:
    """Horizontal sum of columns skipping NULL and NaN; all missing gives 0."""
    if all(isinstance(c, str) for c in cols):
        terms = [f"coalesce(nanvl(CAST({sql_name(c)} AS DOUBLE), CAST(NULL AS DOUBLE)), 0D)" for c in cols]
        return F.expr(" + ".join(terms))
    return reduce(add, [F.coalesce(drop_nan(c), F.lit(0.0)) for c in cols])


def sign_class_counts(x: str) -> list[Column]:
    """Aggregates that classify a double column for exact IEEE re-summation.

    Spark orders NaN above every number, so the sign tests exclude NaN first.
    Returns ``[n_null, n_pos, n_neg, n_zero_or_nan]``.
    """
    x = sql_name(x)
    return [
        F.expr(f"count(1) - count({x})").alias("n_null"),
        F.expr(f"count(CASE WHEN NOT isnan({x}) AND {x} > 0 THEN 1 END)").alias("n_pos"),
        F.expr(f"count(CASE WHEN NOT isnan({x}) AND {x} < 0 THEN 1 END)").alias("n_neg"),
        F.expr(f"count(CASE WHEN isnan({x}) OR {x} = 0 THEN 1 END)").alias("n_zero_nan"),
    ]
