"""Null / NaN / infinity rules, written once.

* Comparisons with a missing value give 0, never null (``flag``).
* Division by zero gives null (ANSI mode would raise otherwise).
* NaN and +/-inf become null so that null is the only "missing".
* ``least`` / ``greatest`` skip nulls in Spark, so clipping keeps null
  explicitly.
* Binning is right-closed ``(a, b]`` like the pandas semantics we match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """0/1 integer flag; a null comparison counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def safe_div(a, b) -> Column:
    """a / b with null for a zero (or null) divisor."""
    return F.try_divide(col_(a).cast("double"), col_(b).cast("double"))


def eps_ratio(a, b, eps: float = 1e-8) -> Column:
    """a / (b + eps); a divisor that is exactly zero after adding eps -> null."""
    return F.try_divide(col_(a).cast("double"), col_(b).cast("double") + F.lit(eps))


def finite(c) -> Column:
    """NaN and +/-infinity -> null."""
    c = col_(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def clip(c, lo=None, hi=None) -> Column:
    """Clip to [lo, hi]; null stays null (least / greatest would drop it)."""
    c = col_(c)
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def bin_right_closed(c, edges: Sequence[float], labels: Sequence | None = None,
                     include_lowest: bool = False) -> Column:
    """pandas ``cut`` semantics: bins ``(e_i, e_{i+1}]``; the lowest edge is
    admitted only with ``include_lowest``; outside or null -> null.
    ``labels=None`` returns the bin index."""
    c = col_(c).cast("double")
    labels = list(range(len(edges) - 1)) if labels is None else list(labels)
    out = None
    for i in range(len(edges) - 1):
        lo, hi = float(edges[i]), float(edges[i + 1])
        low_ok = (c >= F.lit(lo)) if (include_lowest and i == 0) else (c > F.lit(lo))
        cond = low_ok & (c <= F.lit(hi))
        out = F.when(cond, F.lit(labels[i])) if out is None else out.when(cond, F.lit(labels[i]))
    return out


def bin_code(c, edges: Sequence[float], include_lowest: bool = False) -> Column:
    """Integer bin code, -1 for missing or out of range."""
    return F.coalesce(bin_right_closed(c, edges, None, include_lowest), F.lit(-1)).cast("int")


def present_values(cols: Sequence) -> Column:
    """Array of the non-null values of ``cols`` (row-wise)."""
    arr = F.array(*[col_(c).cast("double") for c in cols])
    return F.filter(arr, lambda x: x.isNotNull())


def row_count(cols: Sequence) -> Column:
    return sum((col_(c).isNotNull().cast("int") for c in cols), F.lit(0))


def row_mean(cols: Sequence) -> Column:
    """Row-wise mean skipping nulls (null when all are null)."""
    n = row_count(cols)
    s = sum((F.coalesce(col_(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(n > 0, s / n)


def row_std(cols: Sequence, ddof: int = 1) -> Column:
    """Row-wise standard deviation skipping nulls; null when fewer than
    ddof + 1 values."""
    n = row_count(cols)
    m = row_mean(cols)
    ss = sum((F.coalesce((col_(c).cast("double") - m) * (col_(c).cast("double") - m), F.lit(0.0))
              for c in cols), F.lit(0.0))
    return F.when(n > ddof, F.sqrt(ss / (n - F.lit(ddof))))


def row_min(cols: Sequence) -> Column:
    return F.least(*[col_(c).cast("double") for c in cols]) if len(cols) > 1 else col_(cols[0]).cast("double")


def row_max(cols: Sequence) -> Column:
    return F.greatest(*[col_(c).cast("double") for c in cols]) if len(cols) > 1 else col_(cols[0]).cast("double")


def row_share(cols: Sequence) -> Column:
    """Share of non-null values across ``cols``."""
    return row_count(cols) / F.lit(float(len(cols)))
