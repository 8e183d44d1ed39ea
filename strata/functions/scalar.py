"""Scalar column functions.

All are expressions (codegen-friendly); lenient parsing uses the ``try_``
forms because Spark runs ANSI mode by default.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nulls import bin_code, bin_right_closed, clip, col_, eps_ratio, flag, safe_div  # noqa: F401
from .nulls import row_max, row_mean, row_min, row_share, row_std


def normalise_key(c) -> Column:
    """key as trimmed string."""
    return F.trim(col_(c).cast("string"))


def parse_number(c) -> Column:
    """text -> double, unparsable -> null."""
    return F.trim(col_(c).cast("string")).try_cast("double")


# Python strftime tokens used by the reference -> Spark datetime patterns.
_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}


def spark_pattern(fmt: str) -> str:
    for k, v in _STRFTIME.items():
        fmt = fmt.replace(k, v)
    return fmt


def parse_date(c, fmt: str | None = None) -> Column:
    """lenient date parse (bad -> null); ``fmt`` may be strftime-style."""
    s = F.trim(col_(c).cast("string"))
    if fmt is None:
        return F.to_date(F.try_to_timestamp(s))
    return F.to_date(F.try_to_timestamp(s, F.lit(spark_pattern(fmt))))


def parse_percent(c) -> Column:
    """'4%' -> 0.04."""
    return F.try_divide(F.rtrim(F.trim(col_(c).cast("string")), F.lit("%")).try_cast("double"), F.lit(100.0))


def convert_units(value, unit, rules: Mapping[str, tuple[float, str]]) -> tuple[Column, Column]:
    """multiply values by the factor of their unit and rewrite the unit,
    e.g. ``{'mmol/L': (18.0, 'mg/dL')}``; other units pass through."""
    v, u = col_(value).cast("double"), col_(unit)
    out_v, out_u = v, u
    for src, (factor, target) in rules.items():
        out_v = F.when(u == src, v * F.lit(float(factor))).otherwise(out_v)
        out_u = F.when(u == src, F.lit(target)).otherwise(out_u)
    return out_v, out_u


def date_parts(c) -> list[Column]:
    """year, month, day."""
    c = col_(c)
    return [F.year(c).alias("year"), F.month(c).alias("month"), F.dayofmonth(c).alias("day")]


def calendar_flags(c) -> list[Column]:
    """day of week (0 = Monday), weekend flag, ISO week."""
    c = col_(c)
    return [F.weekday(c).alias("day_of_week"), (F.weekday(c) >= 5).cast("int").alias("is_weekend"),
            F.weekofyear(c).alias("iso_week")]


def age_at(birth, visit, birth_year=None) -> Column:
    """F8: age in years (days / 365.25, 1 decimal); fallback visit year - birth year."""
    exact = F.round(F.datediff(col_(visit), col_(birth)) / 365.25, 1)
    if birth_year is None:
        return exact
    return F.coalesce(exact, (F.year(col_(visit)) - col_(birth_year)).cast("double"))


def years_since(c, as_of: str, lo: float = 0.0, hi: float = 50.0) -> Column:
    """years between the date and ``as_of`` clipped to [lo, hi]."""
    return clip(F.datediff(F.lit(as_of).cast("date"), col_(c)) / 365.25, lo, hi)


def map_codes(c, mapping: Mapping) -> Column:
    """code -> label via a literal map (unknown / null -> null)."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*kv), col_(c)) if kv else F.lit(None)


def map_multicode(c, priority: Sequence[tuple[str, object]], default=None, sep: str = "|") -> Column:
    """split a multi-code field and return the label of the first rule
    (in priority order) whose code is present; ``default`` when codes are
    present but none matches, null when the field is null."""
    codes = F.transform(F.split(col_(c).cast("string"), "\\" + sep if sep in "|.^$*+?()[]{}\\" else sep),
                        lambda x: F.trim(x))
    out = None
    for code, label in priority:
        cond = F.array_contains(codes, str(code))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    out = out.otherwise(F.lit(default)) if out is not None else F.lit(default)
    return F.when(col_(c).isNotNull(), out)


def one_hot_columns(c: str, values: Sequence, prefix: str | None = None) -> list[Column]:
    """0/1 column per value; names lower-cased, spaces -> '_'; null -> 0."""
    prefix = prefix or c
    return [flag(F.col(c) == F.lit(v)).alias(f"{prefix}_{str(v).lower().replace(' ', '_')}") for v in values]


def category_values(df: DataFrame, c: str, top: int | None = None) -> list:
    """Distinct values of a categorical column (most frequent first, ties by
    value): all of them, or the ``top`` ones.  Each becomes a column of the
    result, so their number is that of the columns the caller asks for;
    columns with many values are better numbered by ``label_encode``."""
    rows = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), F.asc(c))
    return [r[c] for r in (rows.limit(top) if top else rows).collect()]


def char_count_flags(c, ch: str) -> tuple[Column, Column]:
    """contains-flag and occurrence count of ``ch`` clipped to 0..2."""
    s = col_(c).cast("string")
    cnt = F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))
    return flag(s.contains(ch)), clip(cnt, 0, 2).cast("int")


# FIXED VALUES (visit code -> months since baseline), as used by the reference:
# bl 0, sc 0, scmri 0, m03 3, m06 6, m12 12, m18 18, m24 24, m30 30, m36 36, m48 48, m60 60, m72 72
VISIT_MONTHS = {"bl": 0, "sc": 0, "scmri": 0, "m03": 3, "m06": 6, "m12": 12, "m18": 18,
                "m24": 24, "m30": 30, "m36": 36, "m48": 48, "m60": 60, "m72": 72}


def visit_months(c, mapping: Mapping[str, int] = VISIT_MONTHS) -> Column:
    """visit code -> months (case-insensitive); unknown -> null."""
    return map_codes(F.lower(col_(c)), mapping).cast("double")


def days_to_months(c) -> Column:
    """F14 numeric branch: days / 30."""
    return col_(c).cast("double") / 30.0


def ordinal_with_severity(dx, severity, labels: Mapping[str, int], refine_at: int,
                          refine: Mapping[float, int]) -> Column:
    """label -> ordinal; rows at ordinal ``refine_at`` are refined by the
    severity column (e.g. global rating 1 / 2 / 3 -> 2 / 3 / 4)."""
    base = map_codes(col_(dx), labels).cast("int")
    out = base
    sev = col_(severity).cast("double")
    for k, v in refine.items():
        out = F.when((base == refine_at) & (sev == float(k)), F.lit(v)).otherwise(out)
    return out


def presence_flag(c) -> Column:
    """1 when not null and != 0."""
    return flag(col_(c).isNotNull() & (col_(c) != 0))


def missing_flag(c) -> Column:
    """1 when null."""
    return col_(c).isNull().cast("int")


def to_epoch(c) -> Column:
    """timestamp / date -> epoch seconds.  A zone-less timestamp is read
    as UTC wall-clock time (independent of the session time zone)."""
    x = col_(c)
    days = F.datediff(F.to_date(x), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)


def scale_to_max(c, max_value: float, threshold: float | None = None) -> Column:
    """x / max, or (x - threshold) / max; a zero max gives null."""
    x = col_(c).cast("double")
    num = x if threshold is None else x - F.lit(float(threshold))
    return safe_div(num, F.lit(float(max_value)))


def row_stats(cols: Sequence, stats: Sequence[str] = ("mean", "std", "min", "max", "share")) -> list[Column]:
    """row-wise statistics across columns, skipping nulls."""
    fn = {"mean": row_mean, "std": row_std, "min": row_min, "max": row_max, "share": row_share}
    return [fn[s](cols).alias(f"row_{s}") for s in stats]
