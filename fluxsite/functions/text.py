"""Scalar text functions of the analysis, as built-in Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxsite import config as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def separator_count(x) -> Column:
    """Number of non-overlapping occupant separators; NULL stays NULL."""
    return F.regexp_count(_c(x), F.lit(C.HEADCOUNT_SEPARATORS))


def headcount_estimate(x) -> Column:
    """People in a room estimated from the free-text occupant list.

    separators + 1; 0 for premises, vehicles, '?', shared rooms and meeting
    rooms; 4 for '4 personnes' (this rule beats the others); NULL stays NULL.
    """
    x = _c(x)
    zero = "|".join(C.HEADCOUNT_ZERO_PATTERNS)
    return (
        F.when(x.isNull(), F.lit(None).cast("double"))
        .when(x.contains(C.HEADCOUNT_FIXED_PATTERN), F.lit(C.HEADCOUNT_FIXED_VALUE))
        .when(F.regexp_like(x, F.lit(zero)), F.lit(0.0))
        .otherwise((separator_count(x) + 1).cast("double"))
    )


def canonical_unit(x, aliases: dict | None = None) -> Column:
    """Upper-cased unit name with spelling aliases resolved; NULL stays NULL."""
    aliases = C.UNIT_ALIASES if aliases is None else aliases
    up = F.upper(_c(x))
    out = up
    for raw, canon in aliases.items():
        out = F.when(up == F.lit(raw.upper()), F.lit(canon)).otherwise(out)
    return out


def member_count(x) -> Column:
    """Members of a shared-premises label 'A/B/C' (slashes + 1) as double."""
    return (F.regexp_count(_c(x), F.lit("/")) + 1).cast("double")


def extract_code(x, start: int, length: int) -> Column:
    """1-based fixed-width code; short labels give a shorter or empty string."""
    return F.substring(_c(x), start, length)


def meter_building_code(x) -> Column:
    return extract_code(x, C.METER_CODE_START, C.METER_CODE_LENGTH)


def staff_building_code(x) -> Column:
    return extract_code(x, C.STAFF_CODE_START, C.STAFF_CODE_LENGTH)


def years_in(x) -> Column:
    """All non-overlapping 20xx years inside a string column (array<string>)."""
    return F.regexp_extract_all(_c(x), F.lit(f"({C.YEAR_PATTERN})"), 1)


def extract_years(header: str) -> list[str]:
    """Driver-side twin of ``years_in`` for sheet headers (metadata only)."""
    return re.findall(C.YEAR_PATTERN, header)


def lenient_double(x) -> Column:
    """String to double; unparsable text gives NULL instead of an error."""
    return _c(x).try_cast("double")


def label_tokens(x) -> Column:
    """Distinct '/'-separated members of a unit label (array<string>)."""
    return F.array_distinct(F.split(_c(x), "/"))


def substrings_without_slash(x, lengths: Column) -> Column:
    """Every distinct substring of a label that holds no '/' and has one of the
    ``lengths`` (array<int>).

    A name without '/' occurs in a label exactly when it equals one of these,
    so 'label contains name' becomes a hash equi-join on the exploded array.
    With the lengths of the names that exist, a label gives at most its length
    times their number.
    """

    def of_length(token: Column, n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(token) - n + 1)
        return F.when(F.length(token) >= n, F.transform(starts, lambda i: F.substring(token, i, n))).otherwise(F.array().cast("array<string>"))

    def per_token(token: Column) -> Column:
        return F.flatten(F.transform(lengths, lambda n: of_length(token, n)))

    return F.array_distinct(F.flatten(F.transform(F.split(_c(x), "/"), per_token)))
