"""Header standardisation of the consumption sheets and the wide/long reshape.

The classification is pure metadata: it runs on ``df.columns`` on the driver
and ends in a single projection, so the data is read once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxsite.functions.nulls import sql_name
from fluxsite.functions.text import extract_years
from fluxsite.sources.sheets import number

CONSO_RE = re.compile(r"^[0-9]{4}_conso$")


def classify_header(name: str) -> str | None:
    """Canonical name of a non-first sheet header, or None when dropped.

    one year + 'conso' (any case)  -> 'YYYY_conso'
    two years, no '%'              -> 'Evol_Y1-Y2'
    two years, '%'                 -> 'Evol_Y1-Y2_p'
    anything else                  -> dropped
    """
    years = extract_years(name)
    if len(years) == 1 and "conso" in name.lower():
        return f"{years[0]}_conso"
    if len(years) == 2:
        suffix = "_p" if "%" in name else ""
        return f"Evol_{years[0]}-{years[1]}{suffix}"
    return None


def header_mapping(columns, keep=()) -> dict[str, str]:
    """Ordered target -> source map. The first column becomes 'batiment'; for a
    repeated target the last source wins but keeps the first position; the
    latest 'YYYY_conso' is copied last as 'derniere_conso'."""
    body = [c for c in columns if c not in keep]
    if not body:
        raise ValueError("empty sheet header")
    out: dict[str, str] = {"batiment": body[0]}
    for name in body[1:]:
        target = classify_header(name)
        if target is not None:
            out[target] = name
    conso = [t for t in out if CONSO_RE.match(t)]
    if conso:
        latest = max(conso, key=lambda t: int(t[:4]))
        out["derniere_conso"] = out[latest]
    return out


def standardise_headers(df: DataFrame, keep=("ordinal",)) -> DataFrame:
    """Rename a consumption sheet to the canonical vocabulary in one select."""
    mapping = header_mapping(df.columns, keep)
    cols = [F.col(sql_name(src)).alias(tgt) for tgt, src in mapping.items()]
    cols += [F.col(k) for k in keep if k in df.columns]
    return df.select(*cols)


def year_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if CONSO_RE.match(c)]


def latest_year_column(df: DataFrame) -> str:
    cols = year_columns(df)
    if not cols:
        raise ValueError("sheet has no 'YYYY_conso' column, so no latest consumption")
    return max(cols, key=lambda t: int(t[:4]))


def unpivot_years(df: DataFrame, ids, value: str = "conso", decimal: str = ".") -> DataFrame:
    """Wide 'YYYY_conso' columns to long (ids..., year int, conso double).

    Values are cast leniently first (mixed types cannot be unpivoted; the
    reference reads the charts' years this way), and NULL cells are kept so a
    missing reading stays a NULL row.
    """
    ycols = year_columns(df)
    if not ycols:
        raise ValueError("no 'YYYY_conso' column to unpivot")
    typed = df.select(*[F.col(i) for i in ids], *[number(F.col(c), decimal, "null").alias(c) for c in ycols])
    long = typed.unpivot(list(ids), ycols, "year_col", value)
    return long.select(
        *[F.col(i) for i in ids],
        F.regexp_replace("year_col", "_conso$", "").cast("int").alias("year"),
        F.col(value),
    )
