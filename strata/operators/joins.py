"""Joins (J1-J14).

Physical strategy is left to Catalyst / AQE: no join is hinted except tables
whose size is bounded by construction (one row per value range).  AQE turns
a join into a broadcast at runtime when the measured side is small and splits
skewed partitions of sort-merge joins.

The theta joins of the reference are rewritten as equi-joins:

* J7 tolerance match ``|a - b| <= tol`` with equal block keys: equi-join on
  (block, bucket of values) against the buckets within ``tol``, then a
  residual filter; tasks are cut by the pairs they compare.
* J8 nearest match: no pairs at all; left and right rows are merged in value
  order and each left row looks back / ahead for the nearest right value
  (windows inside value ranges, carries across ranges from a small table).
* J9 greedy one-to-one match: right rows are cut into value ranges of a
  bounded size that work side by side; left rows that another range may serve
  better go there in the next round, until none moves.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.stats import global_row_number, group_quantiles, same_keys
from ..session import cut_lineage


def _list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def left_join_suffixed(left: DataFrame, right: DataFrame, lkey, rkey=None, suffix: str = "_src",
                       how: str = "left") -> DataFrame:
    """Left equi-join; right columns that clash with left columns get
    ``suffix``.  Same-named keys appear once; differently named keys both stay."""
    lkeys = _list(lkey)
    rkeys = _list(rkey) if rkey is not None else lkeys
    same = lkeys == rkeys
    ren = {}
    for c in right.columns:
        if same and c in rkeys:
            continue
        if c in left.columns:
            ren[c] = f"{c}{suffix}"
    r = right.select([F.col(c).alias(ren.get(c, c)) for c in right.columns])
    if same:
        return left.join(r, lkeys, how)
    rk = [ren.get(k, k) for k in rkeys]
    cond = [left[a] == r[b] for a, b in zip(lkeys, rk)]
    return left.join(r, cond, how)


def outer_join_suffixed(left: DataFrame, right: DataFrame, keys, suffixes=("_x", "_y")) -> DataFrame:
    """Full outer join on same-named keys (keys coalesced); clashing
    columns get a suffix on both sides."""
    keys = _list(keys)
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    l2 = left.select([F.col(c).alias(f"{c}{suffixes[0]}" if c in clash else c) for c in left.columns])
    r2 = right.select([F.col(c).alias(f"{c}{suffixes[1]}" if c in clash else c) for c in right.columns])
    return l2.join(r2, keys, "full")


def inner_join_keys(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Inner join on a composite key."""
    return left.join(right, _list(keys), "inner")


def attach_lookup(df: DataFrame, lookup: DataFrame, keys, cols: Sequence[str]) -> DataFrame:
    """Attach lookup columns by a (multi-column) key; left join."""
    keys = _list(keys)
    return df.join(lookup.select(*keys, *cols), keys, "left")


def attach_group_stat(df: DataFrame, keys, col: str, fn: str = "mean", out: str | None = None) -> DataFrame:
    """Per-group aggregate attached back to every row (aggregate, then join)."""
    keys = _list(keys)
    if fn == "median":
        return same_keys(df, group_quantiles(df, keys, col, [0.5], [out or f"{col}_median"]), keys)
    f = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "std": F.stddev_samp}[fn]
    g = df.groupBy(*keys).agg(f(F.col(col)).alias(out or f"{col}_{fn}"))
    return df.join(g, keys, "left")


def outer_align(dfs: Sequence[DataFrame], key) -> DataFrame:
    """Full outer alignment of pre-aggregated sources on a unique key."""
    return reduce(lambda a, b: a.join(b, _list(key), "full"), dfs)


#: Buckets of values per tolerance: finer ones compare fewer pairs that do not match.
FINE = 4
#: Pairs of equal blocks and neighbouring buckets that one task of J7 compares, about.
TASK_PAIRS = 4_000_000


def tolerance_join(left: DataFrame, right: DataFrame, eq: Sequence[tuple[str, str]], lcol: str, rcol: str,
                   tol: float, diff: str = "diff") -> DataFrame:
    """Candidate pairs with equal block keys and ``|l - r| <= tol``.

    Equi-join on (block, bucket) where bucket = floor(value * FINE / tol); the
    left side is replicated to the buckets that hold its values within
    ``tol``; a residual filter keeps the exact matches.

    Rows say little about this join's work, so its tasks are cut by pairs: a
    bucket of more than TASK_PAIRS of them is cut into slices of right rows
    (and of left rows, where there are more slices than right rows), and the
    number of partitions follows from all pairs.  The partitions are set here,
    as partitions that Spark coalesces by bytes leave all pairs to a few tasks."""
    width = float(tol) / FINE if tol > 0 else 1.0
    value = F.col(lcol).cast("double")
    # the difference that is compared is rounded, so a right value may be this much farther
    reach = F.lit(float(tol)) + (F.abs(value) + float(tol)) * 1e-15
    lb = left.withColumn("_bk", F.explode(F.sequence(F.floor((value - reach) / width), F.floor((value + reach) / width))))
    rb = right.withColumn("_bk", F.floor(F.col(rcol).cast("double") / width))
    blocks = [f"_b{i}" for i in range(len(eq))]
    nl = lb.groupBy(*[F.col(a).alias(n) for (a, _), n in zip(eq, blocks)], "_bk").agg(F.count(F.lit(1)).alias("_nl"))
    nr = rb.groupBy(*[F.col(b).alias(n) for (_, b), n in zip(eq, blocks)], "_bk").agg(F.count(F.lit(1)).alias("_nr"))
    cuts = F.ceil(F.col("_nl").cast("double") * F.col("_nr") / TASK_PAIRS)
    both = nl.join(nr, [*blocks, "_bk"]).withColumn("_rs", F.least(cuts, F.col("_nr")))
    both = cut_lineage(both.withColumn("_ls", F.ceil(cuts / F.col("_rs"))))
    size = both.agg(F.sum(F.col("_nl").cast("double") * F.col("_nr") + F.col("_nl") * F.col("_rs") + F.col("_nr") * F.col("_ls"))).first()[0]
    parts = max(1, math.ceil((size or 0) / TASK_PAIRS))
    several = both.where("_rs > 1 or _ls > 1")
    several = None if several.isEmpty() else several.select(*[F.col(n).alias(f"_s{n}") for n in blocks], F.col("_bk").alias("_sbk"), "_rs", "_ls")

    def sliced(side: DataFrame, keys: Sequence[str], own: str, other: str, names: tuple[str, str]) -> DataFrame:
        """``side`` with the number of its slice and once for each slice of the other side."""
        if several is None:
            return side.withColumns({n: F.lit(0) for n in names})
        on = [side[k] == several[f"_s{n}"] for k, n in zip(keys, blocks)] + [side["_bk"] == several["_sbk"]]
        row = F.xxhash64(*[side[f.name] for f in side.schema.fields if isinstance(f.dataType, T.AtomicType)])
        mine = F.pmod(row, F.coalesce(F.col(own), F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), (F.coalesce(F.col(other), F.lit(1)) - 1).cast("int")))
        return side.join(several, on, "left").select(*[side[c] for c in side.columns], mine.alias(names[0]), every.alias(names[1]))

    lkeys, rkeys = [a for a, _ in eq], [b for _, b in eq]
    lb = sliced(lb, lkeys, "_ls", "_rs", ("_p", "_q")).repartition(parts, *lkeys, "_bk", "_p", "_q")
    rb = sliced(rb, rkeys, "_rs", "_ls", ("_q", "_p")).repartition(parts, *rkeys, "_bk", "_p", "_q")
    cond = [lb[a] == rb[b] for a, b in eq] + [lb[c] == rb[c] for c in ("_bk", "_p", "_q")]
    j = lb.join(rb, cond, "inner")
    j = j.where(F.abs(lb[lcol] - rb[rcol]) <= tol).withColumn(diff, F.abs(lb[lcol] - rb[rcol]))
    return j.drop(*[side[c] for side in (lb, rb) for c in ("_bk", "_p", "_q")])


def nearest_match(left: DataFrame, right: DataFrame, eq: Sequence[tuple[str, str]], lkey: str, lcol: str,
                  rkey: str, rcol: str, tol: float) -> DataFrame:
    """For every left row, the right row with the smallest ``|l - r|``
    within ``tol`` (same block keys); ties -> smallest right key.  Rows with
    a null block key or value match nothing.

    Both sides are first reduced to distinct (block, value), the right side
    with its smallest key, so a value that many rows share is one row here.
    The values are range-partitioned by (block, value); the nearest right
    value below / above comes from running windows inside a partition, and a
    table with one row per block and partition carries it across.  No pairs
    are formed, and a hot block is spread over partitions."""
    blocks = [f"_b{i}" for i in range(len(eq))]
    L = left.select(*[F.col(a).alias(b) for (a, _), b in zip(eq, blocks)], F.col(lkey).alias("_lk"),
                    F.col(lcol).cast("double").alias("_v")).dropna(subset=[*blocks, "_v"])
    R = right.select(*[F.col(b_).alias(b) for (_, b_), b in zip(eq, blocks)], F.col(rkey).alias("_rk"),
                     F.col(rcol).cast("double").alias("_v")).dropna(subset=[*blocks, "_v"])
    none = F.lit(None).cast(R.schema["_rk"].dataType)
    u = R.unionByName(L.select(*blocks, none.alias("_rk"), "_v")).groupBy(*blocks, "_v").agg(F.min("_rk").alias("_rk"))
    u = cut_lineage(u.repartitionByRange(*blocks, "_v").withColumn("_p", F.spark_partition_id()))
    here = F.when(F.col("_rk").isNotNull(), F.struct("_v", "_rk"))
    w = Window.partitionBy(*blocks, "_p").orderBy("_v")
    back = Window.partitionBy(*blocks, "_p").orderBy(F.desc("_v"))
    # looking ahead is looking back in descending order: a frame that ends at the last row is read anew for every row
    near = u.select("*", F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_prev"),
                    F.last(here, True).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("_next"))
    # every (block, partition) has a row here, also where it holds only left values
    per = u.groupBy(*blocks, "_p").agg(F.max(here).alias("_hi"), F.min(here).alias("_lo"))
    wc, wb = Window.partitionBy(*blocks).orderBy("_p"), Window.partitionBy(*blocks).orderBy(F.desc("_p"))
    carry = per.select(*blocks, "_p", F.last("_hi", True).over(wc.rowsBetween(Window.unboundedPreceding, -1)).alias("_cp"),
                       F.last("_lo", True).over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("_cn"))
    near = near.join(carry, [*blocks, "_p"])
    p, n = F.coalesce("_prev", "_cp"), F.coalesce("_next", "_cn")
    dp, dn = F.col("_v") - p["_v"], n["_v"] - F.col("_v")
    okp, okn = F.coalesce(dp <= tol, F.lit(False)), F.coalesce(dn <= tol, F.lit(False))
    prev_wins = F.coalesce((dp < dn) | ((dp == dn) & (p["_rk"] <= n["_rk"])), F.lit(False))
    take_prev = okp & (~okn | prev_wins)
    take_next = okn & ~take_prev
    best = near.select(*blocks, "_v", F.when(take_prev, p["_rk"]).when(take_next, n["_rk"]).alias("_m"),
                       F.when(take_prev, dp).when(take_next, dn).alias("_d")).where(F.col("_m").isNotNull())
    return L.join(cut_lineage(best), [*blocks, "_v"]).select(F.col("_lk").alias(lkey), F.col("_m").alias(f"match_{rkey}"), F.col("_d").alias("diff"))


#: Right rows of one value range of a block.
RANGE_SLOTS = 50_000


class _Slots:
    """Free right rows of a range, in order of value and key."""

    def __init__(self, values: list, keys: list):
        self.values, self.keys = values, keys
        # nearest free place at or after / at or before a place, found by halving the paths walked
        self.after, self.before = list(range(len(values) + 1)), list(range(-1, len(values)))

    @staticmethod
    def _find(link: list, i: int) -> int:
        while link[i] != i:
            link[i] = link[link[i]]
            i = link[i]
        return i

    def nearest(self, v: float, tol: float):
        """(distance, key, place) of the nearest free row within tol (ties:
        smallest key), or None."""
        import bisect

        values, best = self.values, None
        p = bisect.bisect_left(values, v)
        r = self._find(self.after, p)
        if r < len(values) and values[r] <= v + tol:
            best = (abs(values[r] - v), self.keys[r], r)
        left = self._before(p)
        if left >= 0 and values[left] >= v - tol:
            # of equal values the first free one has the smallest key
            left = self._find(self.after, bisect.bisect_left(values, values[left]))
            found = (abs(values[left] - v), self.keys[left], left)
            if best is None or found < best:
                best = found
        return best

    def _before(self, p: int) -> int:
        """The last free place before p; places are shifted by one, 0 is none."""
        i = p
        while self.before[i] != i - 1:
            nxt = self.before[i] + 1
            self.before[i] = self.before[nxt] if self.before[nxt] != nxt - 1 else self.before[i]
            i = nxt
        return i - 1

    def take(self, place: int) -> None:
        self.after[place] = place + 1
        self.before[place + 1] = self.before[place]


def greedy_match(left: DataFrame, right: DataFrame, eq: Sequence[tuple[str, str]], lkey: str, lorder: str,
                 lcol: str, rkey: str, rcol: str, tol: float) -> DataFrame:
    """Sequential one-to-one matching.  Left rows in ``lorder`` (ties: by
    key; null last) each take the nearest (ties -> smallest right key)
    still-unused right row of the same block within ``tol``.  Rows without a
    value or with a null block match nothing; keys must not be null.

    Right rows of a block are cut into ranges of RANGE_SLOTS rows, in order of
    value and key, and matching goes in rounds.  A left row is at the range
    that can hold its nearest right row; each range serves the rows that are
    there in their order.  A row whose nearest free right row there is farther
    than another range may offer (a bound that only grows) goes to that range
    for the next round, with what it saw.  Right rows thus keep the earliest
    row that asked, and refused rows go on to their next nearest; as all right
    rows rank left rows alike, this ends in the sequential result, in whatever
    order ranges work.  A range's right rows are in memory, its left rows are
    streamed; only the ranges of blocks with more than one reach the driver.
    """
    import bisect
    import pickle

    blocks, tol = [f"_b{i}" for i in range(len(eq))], float(tol)
    has_block = reduce(lambda x, y: x & y, [F.col(b).isNotNull() for b in blocks], F.lit(True))
    R = right.select(*[F.col(b).alias(n) for (_, b), n in zip(eq, blocks)], F.col(rkey).alias("_rk"),
                     F.col(rcol).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & has_block)
    L = left.select(*[F.col(a).alias(n) for (a, _), n in zip(eq, blocks)], F.col(lkey).alias("_lk"),
                    F.col(lorder).alias("_lo"), F.col(lcol).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & has_block)
    ranges: dict[tuple, list] = {}
    several = R.groupBy(*blocks).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > RANGE_SLOTS).drop("_n")
    extents = []
    if several.isEmpty():
        R = R.withColumn("_q", F.lit(0))
    else:
        numbered = global_row_number(R.join(several, blocks, "left_semi"), blocks, ["_v", "_rk"], "_rn")
        cut = numbered.select(*R.columns, F.floor((F.col("_rn") - 1) / RANGE_SLOTS).cast("int").alias("_q"))
        extents = cut.groupBy(*blocks, "_q").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.min("_rk").alias("k")).collect()
        R = cut.unionByName(R.join(several, blocks, "left_anti").withColumn("_q", F.lit(0)))
    for r in sorted(extents, key=lambda r: r["_q"]):
        ranges.setdefault(tuple(r[b] for b in blocks), []).append((r["lo"], r["hi"], r["k"]))
    edges = {b: ([x[0] for x in e], [x[1] for x in e]) for b, e in ranges.items()}

    def best_range(block: tuple, v: float, seen: dict):
        """(bound, range) where the nearest right row may be, or None."""
        lows, highs = edges[block]
        found = None
        for q in range(bisect.bisect_left(highs, v - tol), bisect.bisect_right(lows, v + tol)):
            lo, hi, k = ranges[block][q]
            bound = seen.get(q, (max(0.0, lo - v, v - hi), k))
            if bound is not None and (found is None or (bound, q) < found):
                found = (bound, q)
        return found

    def place(batches):
        for f in batches:
            q = []
            for *block, v in zip(*(f.column(c).to_pylist() for c in [*blocks, "_v"])):
                at = best_range(tuple(block), v, {}) if tuple(block) in ranges else (None, 0)
                q.append(at[1] if at else -1)
            yield f.append_column("_q", pa.array(q, pa.int32()))

    kinds = ", ".join(f"`{n}` {t}" for n, t in L.dtypes)
    rows = (L.mapInArrow(place, f"{kinds}, _q int").where("_q >= 0") if ranges else L.withColumn("_q", F.lit(0)))
    rows = rows.withColumn("_seen", F.lit(None).cast("binary"))
    order = [*blocks, "_q", "_kind", F.asc_nulls_last("_lo"), "_lk", "_v", "_rk"]
    key_type, seen_type = right.schema[rkey].dataType, T.BinaryType()
    slots = R.select(*blocks, "_q", F.lit(0).alias("_kind"), F.lit(None).cast(L.schema["_lo"].dataType).alias("_lo"),
                     F.lit(None).cast(L.schema["_lk"].dataType).alias("_lk"), "_v", "_rk", F.lit(None).cast(seen_type).alias("_seen"))
    names = [*blocks, "_q", "_lk", "_lo", "_v", "_seen"]
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField("_rk", key_type), T.StructField("_d", T.DoubleType()), T.StructField("_moved", T.BooleanType())])

    types = to_arrow_schema(schema)

    def serve(batches):
        now, free, values, keys = None, None, [], []
        for f in batches:
            out = []
            for row in zip(*(f.column(c).to_pylist() for c in [*blocks, "_q", "_kind", "_lk", "_lo", "_v", "_seen", "_rk"])):
                block, q, kind, lk, lo, v, seen, rk = row[:len(blocks)], *row[len(blocks):]
                if (block, q) != now:
                    now, free, values, keys = (block, q), None, [], []
                if kind == 0:
                    values.append(v)
                    keys.append(rk)
                    continue
                if free is None:
                    free = _Slots(values, keys)
                got = free.nearest(v, tol)
                if block in ranges:
                    known = pickle.loads(seen) if seen else {}
                    known[q] = got[:2] if got else None
                    other = best_range(block, v, known)
                    if other is not None and other[1] != q:
                        out.append((*block, other[1], lk, lo, v, pickle.dumps(known), None, None, True))
                        continue
                    seen = pickle.dumps({k: b for k, b in known.items() if k != q})
                if got:
                    free.take(got[2])
                out.append((*block, q, lk, lo, v, seen, got[1] if got else None, got[0] if got else None, False))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), types)], schema=types)

    result = None
    while True:
        asked = rows.select(*blocks, "_q", F.lit(1).alias("_kind"), "_lo", "_lk", "_v", F.lit(None).cast(key_type).alias("_rk"), "_seen")
        served = slots.unionByName(asked).repartition(*blocks, "_q").sortWithinPartitions(*order).mapInArrow(serve, schema)
        if not ranges:
            result = served
            break
        served = cut_lineage(served)
        if served.where("_moved").isEmpty():
            result = served
            break
        rows = served.select(*names)
    return result.where(F.col("_rk").isNotNull()).select(F.col("_lk").alias(lkey), F.col("_rk").alias(f"match_{rkey}"), F.col("_d").alias("diff"))


def key_overlap(sources: Mapping[str, DataFrame], key: str) -> DataFrame:
    """|keys(a) intersect keys(b)| for every ordered source pair; the
    diagonal is the number of distinct keys of the source.  Per key there are
    at most (number of sources)^2 pairs."""
    u = reduce(lambda a, b: a.unionByName(b),
               [df.select(F.lit(name).alias("source"), F.col(key).cast("string").alias("_k")).distinct()
                for name, df in sources.items()])
    a = u.select(F.col("source").alias("source_a"), "_k")
    b = u.select(F.col("source").alias("source_b"), "_k")
    return a.join(b, "_k").groupBy("source_a", "source_b").agg(F.count(F.lit(1)).alias("n_common"))


def join_order(sources: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Sources by distinct key count, descending (ties by name)."""
    u = reduce(lambda a, b: a.unionByName(b),
               [df.select(F.lit(name).alias("source"), F.col(key).cast("string").alias("_k")) for name, df in sources.items()])
    g = u.groupBy("source").agg(F.count_distinct("_k").alias("n_subjects"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_subjects"), "source")))


def map_values(df: DataFrame, col: str, mapping, out: str | None = None, key: str | None = None,
               value: str | None = None) -> DataFrame:
    """Map a column through a small dict (literal map) or a mapping table
    (left join; AQE broadcasts it when its measured size is small)."""
    out = out or f"{col}_mapped"
    if isinstance(mapping, Mapping):
        kv = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
        return df.withColumn(out, F.element_at(F.create_map(*kv), F.col(col)))
    m = mapping.select(F.col(key).alias("_mk"), F.col(value).alias(out))
    return df.join(m, df[col] == m["_mk"], "left").drop("_mk")
