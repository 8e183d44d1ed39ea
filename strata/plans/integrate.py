"""Multi-source integration (J10) with its step log.

The plan is a list of steps, each a left join of one source onto the running
wide table; Catalyst sees the whole chain at once (one job), keeps the user's
order, prunes unused columns into every scan and AQE picks broadcast or
sort-merge per join from runtime sizes.  A source with repeated keys fans the
base rows out, as in the reference; ``collapse`` reduces such a source to one
row per key first (first non-null per column in a given order, or medians).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.agg import median_per_key
from ..operators.joins import left_join_suffixed
from ..operators.windows import first_non_null


@dataclass
class Step:
    name: str
    source: DataFrame
    left_key: Sequence[str] | str
    right_key: Sequence[str] | str | None = None
    suffix: str | None = None
    collapse: str | None = None          # None | "first" | "median"
    order: Sequence[str] = field(default_factory=list)


def _collapse(step: Step) -> DataFrame:
    keys = [step.right_key or step.left_key] if isinstance(step.right_key or step.left_key, str) \
        else list(step.right_key or step.left_key)
    if step.collapse == "first":
        return first_non_null(step.source, keys, list(step.order) or keys)
    if step.collapse == "median":
        num = [c for c, t in step.source.dtypes if c not in keys and t in ("double", "float", "int", "bigint")]
        return median_per_key(step.source, keys, num)
    return step.source


def integrate(base: DataFrame, steps: Sequence[Step], explain: bool = False):
    """Fold the steps onto ``base``.  Returns ``(wide, log)``; ``log`` is None
    unless ``explain=True``, in which case it is a small DataFrame with one
    row per step: rows and columns before and after (one count per step)."""
    cur = base
    log_rows = []
    before_rows = base.count() if explain else None
    for st in steps:
        src = _collapse(st)
        nxt = left_join_suffixed(cur, src, st.left_key, st.right_key, st.suffix or f"_{st.name}")
        if explain:
            after_rows = nxt.count()
            log_rows.append((st.name, before_rows, len(cur.columns), after_rows, len(nxt.columns)))
            before_rows = after_rows
        cur = nxt
    log = None
    if explain:
        log = base.sparkSession.createDataFrame(
            log_rows, "step string, rows_before long, cols_before int, rows_after long, cols_after int")
    return cur, log
