"""Scalar functions F1-F26 bound to the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nulls as N
from ..functions import scalar as S
from .basics import LI_NULL, li_null
from .registry import register, rounded, table


@register("f1_normalise_key", "SELECT trim('  ' || CAST(c_custkey AS VARCHAR) || ' ') AS subject_id FROM customer")
def f1(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(S.normalise_key(F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit(" "))).alias("subject_id"))


@register("f2_parse_number", """SELECT event_id, TRY_CAST(trim(CASE WHEN event_id % 5 = 0 THEN 'x' || CAST(value AS VARCHAR) ELSE CAST(value AS VARCHAR) END) AS DOUBLE) AS value FROM events""")
def f2(spark, sf):
    e = table(spark, sf, "events")
    txt = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    return rounded(e.select("event_id", S.parse_number(txt).alias("value")))


@register("f3_parse_date", """SELECT o_orderkey, CAST(CAST(try_strptime(CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%m-%Y') END, '%m-%Y') AS DATE) AS VARCHAR) AS birth_month FROM orders""")
def f3(spark, sf):
    o = table(spark, sf, "orders")
    txt = F.when(F.col("o_orderkey") % 11 == 0, F.lit("unknown")).otherwise(F.date_format("o_orderdate", "MM-yyyy"))
    return o.select("o_orderkey", S.parse_date(txt, "%m-%Y").alias("birth_month"))


@register("f4_parse_percent", """SELECT l_orderkey, l_linenumber, round(TRY_CAST(rtrim(CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) || '%', '%') AS DOUBLE) / 100.0, 6) AS cv FROM lineitem""")
def f4(spark, sf):
    li = table(spark, sf, "lineitem")
    txt = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
    return rounded(li.select("l_orderkey", "l_linenumber", S.parse_percent(txt).alias("cv")))


@register("f5_convert_units", """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'R' THEN l_quantity * 18.0 ELSE l_quantity END, 6) AS value,
  CASE WHEN l_returnflag = 'R' THEN 'mg/dL' ELSE 'mg/dL' END AS unit FROM lineitem""")
def f5(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("unit", F.when(F.col("l_returnflag") == "R", "mmol/L").otherwise("mg/dL"))
    v, u = S.convert_units("l_quantity", "unit", {"mmol/L": (18.0, "mg/dL")})
    return rounded(li.select("l_orderkey", "l_linenumber", v.alias("value"), u.alias("unit")))


@register("f6_date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day FROM orders")
def f6(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *S.date_parts("o_orderdate"))


@register("f7_calendar_flags", """SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, CAST(weekofyear(ts) AS INTEGER) AS iso_week FROM events""")
def f7(spark, sf):
    return table(spark, sf, "events").select("event_id", *S.calendar_flags("ts"))


@register("f8_age_at", """SELECT l_orderkey, l_linenumber, round(coalesce(round(CASE WHEN o_orderkey % 7 <> 0 THEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) END / 365.25, 1),
  year(l_shipdate) - year(o_orderdate)), 6) AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def f8(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("visit"))
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("birth"),
                                          F.year("o_orderdate").alias("birth_year"))
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return rounded(j.select("l_orderkey", "l_linenumber", S.age_at("birth", "visit", "birth_year").alias("age")))


@register("f9_years_since", """SELECT o_custkey, round(max(least(greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') / 365.25, 0), 50)), 6) AS years_max,
  CAST(max(CASE WHEN least(greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') / 365.25, 0), 50) <= 2 THEN 1 ELSE 0 END) AS INTEGER) AS recent
FROM orders GROUP BY o_custkey""")
def f9(spark, sf):
    o = table(spark, sf, "orders").withColumn("ys", S.years_since(F.to_date("o_orderdate"), "2000-01-01"))
    return rounded(o.groupBy("o_custkey").agg(F.max("ys").alias("years_max"),
                                              F.max(N.flag(F.col("ys") <= 2)).alias("recent")))


@register("f10_map_codes", """SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN 'male' WHEN 2 THEN 'female' END AS gender FROM customer""")
def f10(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", S.map_codes(F.col("c_custkey") % 3, {1: "male", 2: "female"}).alias("gender"))


@register("f11_map_multicode", """SELECT p_partkey, CASE WHEN list_contains(string_split(replace(p_name, ' ', '|'), '|'), 'ring') THEN 'R'
  WHEN list_contains(string_split(replace(p_name, ' ', '|'), '|'), 'bolt') THEN 'B'
  WHEN list_contains(string_split(replace(p_name, ' ', '|'), '|'), 'red') THEN 'red' ELSE 'other' END AS category FROM part""")
def f11(spark, sf):
    p = table(spark, sf, "part").withColumn("codes", F.regexp_replace("p_name", " ", "|"))
    return p.select("p_partkey", S.map_multicode("codes", [("ring", "R"), ("bolt", "B"), ("red", "red")], "other").alias("category"))


@register("f12_one_hot", """SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS seg_automobile, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS seg_building,
  CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS seg_furniture, CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS seg_household,
  CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS seg_machinery FROM customer""")
def f12(spark, sf):
    c = table(spark, sf, "customer")
    vals = sorted(S.category_values(c, "c_mktsegment"))
    return c.select("c_custkey", *S.one_hot_columns("c_mktsegment", vals, "seg"))


@register("f13_char_count_flags", """SELECT p_partkey, CAST(contains(p_brand, '1') AS INTEGER) AS has_1,
  CAST(least(greatest(length(p_brand) - length(replace(p_brand, '1', '')), 0), 2) AS INTEGER) AS n_1 FROM part""")
def f13(spark, sf):
    p = table(spark, sf, "part")
    has, cnt = S.char_count_flags("p_brand", "1")
    return p.select("p_partkey", has.alias("has_1"), cnt.alias("n_1"))


@register("f14_visit_months", """SELECT o_orderkey, CAST(CASE lower(CASE o_orderkey % 6 WHEN 0 THEN 'bl' WHEN 1 THEN 'm06' WHEN 2 THEN 'M12' WHEN 3 THEN 'sc' WHEN 4 THEN 'm99' ELSE 'm72' END)
  WHEN 'bl' THEN 0 WHEN 'sc' THEN 0 WHEN 'm06' THEN 6 WHEN 'm12' THEN 12 WHEN 'm72' THEN 72 END AS DOUBLE) AS months FROM orders""")
def f14(spark, sf):
    o = table(spark, sf, "orders")
    code = (F.when(F.col("o_orderkey") % 6 == 0, "bl").when(F.col("o_orderkey") % 6 == 1, "m06")
            .when(F.col("o_orderkey") % 6 == 2, "M12").when(F.col("o_orderkey") % 6 == 3, "sc")
            .when(F.col("o_orderkey") % 6 == 4, "m99").otherwise("m72"))
    return rounded(o.select("o_orderkey", S.visit_months(code).alias("months")))


BIN_SQL = """CASE WHEN l_discount >= 0 AND l_discount <= 0.03 THEN 'low' WHEN l_discount > 0.03 AND l_discount <= 0.06 THEN 'mid'
  WHEN l_discount > 0.06 AND l_discount <= 0.09 THEN 'high' END"""


@register("f15_bin_right_closed", f"""SELECT l_orderkey, l_linenumber, {BIN_SQL} AS band,
  CASE WHEN l_discount > 0 AND l_discount <= 0.03 THEN 'low' WHEN l_discount > 0.03 AND l_discount <= 0.06 THEN 'mid' WHEN l_discount > 0.06 AND l_discount <= 0.09 THEN 'high' END AS band_open FROM lineitem""")
def f15(spark, sf):
    li = table(spark, sf, "lineitem")
    e, lab = [0, 0.03, 0.06, 0.09], ["low", "mid", "high"]
    return li.select("l_orderkey", "l_linenumber", N.bin_right_closed("l_discount", e, lab, True).alias("band"),
                     N.bin_right_closed("l_discount", e, lab, False).alias("band_open"))


@register("f16_bin_code", f"""WITH {LI_NULL} SELECT l_orderkey, l_linenumber, CAST(coalesce(CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 0
  WHEN l_quantity > 10 AND l_quantity <= 25 THEN 1 WHEN l_quantity > 25 AND l_quantity <= 45 THEN 2 END, -1) AS INTEGER) AS code FROM li""")
def f16(spark, sf):
    return li_null(spark, sf).select("l_orderkey", "l_linenumber", N.bin_code("l_quantity", [0, 10, 25, 45]).alias("code"))


@register("f17_safe_ratio", """SELECT l_orderkey, l_linenumber, round(l_tax / (l_discount + 1e-8), 6) AS eps_ratio, round(l_tax / nullif(l_discount, 0), 6) AS ratio FROM lineitem""")
def f17(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", N.eps_ratio("l_tax", "l_discount").alias("eps_ratio"),
                             N.safe_div("l_tax", "l_discount").alias("ratio")))


@register("f18_log1p_square", "SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity), 6) AS log_qty, round(l_quantity * l_quantity, 6) AS sq_qty FROM lineitem")
def f18(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", F.log1p("l_quantity").alias("log_qty"), F.pow("l_quantity", 2).alias("sq_qty")))


ROW_COLS_SQL = "[l_quantity, l_discount * 100, l_tax * 100]"


@register("f19_row_stats", f"""WITH {LI_NULL}, a AS (SELECT l_orderkey, l_linenumber, list_filter({ROW_COLS_SQL}, lambda x: x IS NOT NULL) AS v FROM li)
SELECT l_orderkey, l_linenumber, round(list_avg(v), 6) AS row_mean, round(CASE WHEN len(v) > 1 THEN list_stddev_samp(v) END, 6) AS row_std,
  round(list_min(v), 6) AS row_min, round(list_max(v), 6) AS row_max, round(len(v) / 3.0, 6) AS row_share FROM a""")
def f19(spark, sf):
    li = li_null(spark, sf)
    cols = [F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100]
    return rounded(li.select("l_orderkey", "l_linenumber", *S.row_stats(cols)))


@register("f20_ordinal_with_severity", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) = '1' THEN 2
  WHEN o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) = '2' THEN 3 WHEN o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) = '3' THEN 4
  ELSE CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END END AS dx_ordinal FROM orders""")
def f20(spark, sf):
    o = table(spark, sf, "orders").withColumn("sev", F.substring("o_orderpriority", 1, 1).cast("double"))
    return o.select("o_orderkey", S.ordinal_with_severity("o_orderstatus", "sev", {"F": 0, "O": 1, "P": 2}, 2,
                                                          {1: 2, 2: 3, 3: 4}).alias("dx_ordinal"))


@register("f21_presence_flag", f"WITH {LI_NULL} SELECT l_orderkey, l_linenumber, CAST(coalesce(l_discount IS NOT NULL AND l_discount <> 0, false) AS INTEGER) AS has_discount FROM li")
def f21(spark, sf):
    return li_null(spark, sf).select("l_orderkey", "l_linenumber", S.presence_flag("l_discount").alias("has_discount"))


@register("f22_clip", f"WITH {LI_NULL} SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IS NOT NULL THEN least(greatest(l_quantity, 5), 45) END AS q FROM li")
def f22(spark, sf):
    return rounded(li_null(spark, sf).select("l_orderkey", "l_linenumber", N.clip("l_quantity", 5, 45).alias("q")))


@register("f23_missing_flag", f"WITH {LI_NULL} SELECT l_orderkey, l_linenumber, CAST(l_tax IS NULL AS INTEGER) AS tax_missing FROM li")
def f23(spark, sf):
    return li_null(spark, sf).select("l_orderkey", "l_linenumber", S.missing_flag("l_tax").alias("tax_missing"))


@register("f24_to_epoch", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS epoch_s FROM orders")
def f24(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.to_epoch("o_orderdate").alias("epoch_s"))


@register("f25_length_range", "SELECT CAST(min(length(text)) AS INTEGER) AS text_min_len, CAST(max(length(text)) AS INTEGER) AS text_max_len, CAST(min(length(lang)) AS INTEGER) AS lang_min_len, CAST(max(length(lang)) AS INTEGER) AS lang_max_len FROM documents")
def f25(spark, sf):
    from ..operators.quality import length_range
    return length_range(table(spark, sf, "documents"), ["text", "lang"])


@register("f26_scale_to_max", """SELECT l_orderkey, l_linenumber, round(l_quantity / 50.0, 6) AS q_norm, round((l_quantity - 25) / 50.0, 6) AS q_dist, CAST(NULL AS DOUBLE) AS q_zero FROM lineitem""")
def f26(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", S.scale_to_max("l_quantity", 50).alias("q_norm"),
                             S.scale_to_max("l_quantity", 50, 25).alias("q_dist"), S.scale_to_max("l_quantity", 0).alias("q_zero")))
