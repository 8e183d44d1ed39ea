"""Bindings of the operators onto the benchmark tables, with DuckDB SQL where
SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.bootstrap_pii import KINDS, find_pii, joined
from strata.llm.chain_dedup import repeated_passages
from strata.llm.chunk_pieces import decode_pieces, encode_pieces
from strata.llm.circulant_minhash import near_components
from strata.llm.complement_packing import pack_documents
from strata.llm.golomb_dedup import exact_dedup
from strata.llm.list_asof import filter_captures
from strata.llm.maxent_lm import score_texts
from strata.llm.pivot_index import vector_links
from strata.llm.rank_index import fill_in_middle, restored_text
from strata.llm.simple8b import token_file_round_trip
from strata.llm.subword_quality import classify_quality
from strata.llm.token_alignment import aligned_tokens, link_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op5_exact_dedup", """
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                      regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
    r AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                 first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
""")
def op5_exact_dedup(spark, sf_dir):
    """Exact dedup of every whole text of `documents`."""
    return exact_dedup(table(spark, sf_dir, "documents")).drop("suspect")


@register("op2_sentencepiece")
def op2_sentencepiece(spark, sf_dir):
    """ids of every whole text of `documents` and their decoded text, as
    digests."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    """Every document's tokens packed into sequences of at most 2048."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


@register("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    """Quality score of every whole text of `documents`."""
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate components of every whole text of `documents`."""
    return near_components(table(spark, sf_dir, "documents"))


@register("op8_bootstrap_pii")
def op8_bootstrap_pii(spark, sf_dir):
    """Personal data in every whole text of `documents`."""
    found = find_pii(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.sort_array(F.concat("base", "more"))).alias("spans"))


@register("op6_maxent_lm")
def op6_maxent_lm(spark, sf_dir):
    """Language-model and base scores of every whole text of `documents`."""
    return score_texts(table(spark, sf_dir, "documents"))


@register("op1_pivot_near_dedup")
def op1_pivot_near_dedup(spark, sf_dir):
    """Links and components of all rows of `embeddings`."""
    return vector_links(table(spark, sf_dir, "embeddings"))


def dated_captures(spark, sf_dir):
    """Stand-in input: `pages` carries no fetch dates, so each page gets one
    from its id."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2021-01-01', cast(pmod(page_id * 7919, 1461) as int))").alias("fetched"))


def dated_entries(spark, sf_dir):
    """Stand-in input: list events for the hosts of `pages`.  Every host is
    listed as itself, by its domain or with a path, removed later, and every
    other one is listed again."""
    hosts = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host")).groupBy("host").agg(
        F.min("page_id").alias("m"), F.min("url").alias("u"))
    hosts = hosts.filter("host <> ''").selectExpr(
        "CASE WHEN m % 4 = 0 THEN 'trusted' ELSE 'unsafe' END AS list", "CASE WHEN m % 4 = 0 THEN 'allow' ELSE 'block' END AS verdict",
        "CASE m % 3 WHEN 0 THEN 'host' WHEN 1 THEN 'domain' ELSE 'prefix' END AS kind",
        "CASE m % 3 WHEN 0 THEN host WHEN 1 THEN regexp_extract(host, '([^.]+[.][^.]+)$', 1) ELSE concat(host, regexp_extract(u, '^[a-z]+://[^/?#]+(/[^/?#]*)', 1)) END AS pattern",
        "date_add(date'2021-01-01', cast(m * 37 % 1200 as int)) AS d0", "m")
    shown = "explode(filter(array(named_struct('day', d0, 'action', 'add'), named_struct('day', date_add(d0, cast(60 + m % 500 as int)), 'action', 'remove'), " \
            "named_struct('day', CASE WHEN m % 2 = 0 THEN date_add(d0, cast(150 + m % 500 as int)) END, 'action', 'add')), e -> e.day IS NOT NULL)) AS e"
    return hosts.selectExpr("list", "verdict", "kind", "pattern", shown).select("list", "verdict", "kind", "pattern", "e.day", "e.action")


@register("op9_url_list_asof", """
    WITH captures AS (
      SELECT page_id, url, DATE '2021-01-01' + CAST(page_id * 7919 % 1461 AS INTEGER) AS fetched,
             regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '[.]$', '') AS host,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
    hosts AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, min(page_id) AS m, min(url) AS u FROM pages GROUP BY 1),
    entries AS (
      SELECT CASE WHEN m % 4 = 0 THEN 'trusted' ELSE 'unsafe' END AS list, CASE WHEN m % 4 = 0 THEN 'allow' ELSE 'block' END AS verdict,
             CASE m % 3 WHEN 0 THEN 'host' WHEN 1 THEN 'domain' ELSE 'prefix' END AS kind,
             CASE m % 3 WHEN 0 THEN host WHEN 1 THEN regexp_extract(host, '([^.]+[.][^.]+)$', 1)
                        ELSE host || regexp_extract(u, '^[a-z]+://[^/?#]+(/[^/?#]*)', 1) END AS pattern,
             DATE '2021-01-01' + CAST(m * 37 % 1200 AS INTEGER) AS d0, m FROM hosts WHERE host <> ''),
    events AS (
      SELECT list, verdict, kind, pattern, d0 AS day, 1 AS is_on FROM entries UNION ALL
      SELECT list, verdict, kind, pattern, d0 + CAST(60 + m % 500 AS INTEGER), 0 FROM entries UNION ALL
      SELECT list, verdict, kind, pattern, d0 + CAST(150 + m % 500 AS INTEGER), 1 FROM entries WHERE m % 2 = 0),
    daily AS (SELECT list, verdict, kind, pattern, day, min(is_on) AS is_on FROM events GROUP BY ALL),
    intervals AS (SELECT *, lead(day) OVER (PARTITION BY list, verdict, kind, pattern ORDER BY day) AS until FROM daily),
    asked AS (
      SELECT page_id, fetched, 'host' AS kind, host AS pattern FROM captures WHERE host <> '' UNION ALL
      SELECT page_id, fetched, 'domain', array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
        FROM (SELECT page_id, fetched, host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM captures WHERE host <> '') UNION ALL
      SELECT page_id, fetched, 'prefix', host || array_to_string(list_slice(string_split(path, '/'), 1, i + 1), '/')
        FROM (SELECT page_id, fetched, host, path, unnest(range(1, len(string_split(path, '/')))) AS i FROM captures WHERE host <> '' AND path <> '')),
    active AS (
      SELECT a.page_id, i.pattern, i.day, i.verdict,
             row_number() OVER (PARTITION BY a.page_id ORDER BY length(i.pattern) DESC, i.kind DESC, i.verdict DESC, i.list DESC, i.pattern DESC) AS r,
             count(*) OVER (PARTITION BY a.page_id) AS n
      FROM asked a JOIN intervals i ON a.kind = i.kind AND a.pattern = i.pattern AND i.is_on = 1 AND i.day <= a.fetched AND (i.until IS NULL OR a.fetched < i.until))
    SELECT c.page_id, c.host, strftime(c.fetched, '%Y-%m-%d') AS fetched, coalesce(a.n, 0) AS n_active, a.pattern AS ruling,
           strftime(a.day, '%Y-%m-%d') AS listed_from, coalesce(a.verdict = 'block', false) AS blocked
    FROM captures c LEFT JOIN active a ON a.page_id = c.page_id AND a.r = 1
""")
def op9_url_list_asof(spark, sf_dir):
    """Every capture of `pages` judged by the list entries active when it was
    fetched."""
    done = filter_captures(dated_captures(spark, sf_dir), dated_entries(spark, sf_dir))
    return done.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("fetched", "listed_from")})


@register("op7_chained_passages")
def op7_chained_passages(spark, sf_dir):
    """Passages of at least 50 words that documents share, over every whole
    text of `documents`."""
    return repeated_passages(table(spark, sf_dir, "documents"))


@register("op12_simple8b_tokens")
def op12_simple8b_tokens(spark, sf_dir):
    """ids of every whole text of `documents`, written to Simple-8b files in
    ascending doc_id order and read back."""
    return token_file_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


@register("op13_fill_in_middle", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
    u AS (SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
                 CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d FROM d),
    f AS (SELECT doc_id, t, n, least(a, b) AS i, greatest(a, b) AS j,
                 CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
                      WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT *, substring(t, 1, i) AS prefix, substring(t, i + 1, j - i) AS middle, substring(t, j + 1) AS suffix FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
""")
def op13_fill_in_middle(spark, sf_dir):
    """Every whole text of `documents` in a fill-in-the-middle form, and the
    text rebuilt from it, as digests."""
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(restored_text(F.col("output"), F.col("form"))).alias("restored_sha256"))


@register("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    """Every whole text of `documents` under two tokenizers: their common
    groups as a digest, and how usual the links in them are."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = aligned_tokens(table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return link_counts(aligned.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256"), *paths)
