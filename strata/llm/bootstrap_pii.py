"""Personal data by rules and by bootstrapped contextual extraction, in
DataFrame functions only.

Rule matches (email, ip, card, phone) are the seed entities.  Identifier-like
runs of tokens around and beside them, with the words next to them, form a
pattern-instance graph: a pattern is the word to the left, the word to the
right, or both; an instance is one run in one text.  In turns, patterns are
scored by how sure their instances are, and runs that no rule matches by the
sure patterns they stand in; runs that end up sure enough are added as spans
of the pattern's kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import cut_lineage

#: FIXED VALUES: the kinds in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")

# The rules, written so that a search never reads a run of characters twice (texts may be one very long run): a match can
# only begin where the run begins or the match before ended, and repeated groups are possessive where nothing that follows
# could match otherwise.  They match what the plain patterns match:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                  phone \+[0-9][\x20().0-9-]+[0-9]
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold a match at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

_SP = r"\x20\x09-\x0D"
#: Runs of white-space separated tokens that hold a digit or an @ each: what an identifier may look like.
RUN = rf"(?<![^{_SP}])[^{_SP}0-9@]*+[0-9@][^{_SP}]*+(?:\x20[^{_SP}0-9@]*+[0-9@][^{_SP}]*+)*+"
#: Characters of the neighbourhood in which a context word is looked for.
REACH = 60

#: A pattern counts from so many texts with seeds, and is sure from this share of its instances; the same holds for a run.
SUPPORT, CONFIDENCE, TURNS = 5, 0.9, 3


def valid(kind: str, match: Column) -> Column:
    """The rule's further test of a match."""
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.coalesce(F.call_function("luhn_check", F.when(F.length(digits).between(14, 19), digits).otherwise(F.lit("0"))), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _found(kind: str, pattern: str, text: Column, possible: Column) -> Column:
    """array of (kind, i, gap before match i, match, left word, right word)."""
    kept = F.when(possible, text).otherwise(F.lit(""))
    pieces, matches = F.split(kept, pattern, -1), F.regexp_extract_all(kept, F.lit(pattern), F.lit(0))
    # matches meet the text before and after them as arrays, so that a text is cut once and not once for each match
    both = F.zip_with(matches, pieces, lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    if kind == "run":
        def left(piece):
            return F.lower(F.regexp_extract(F.substring(piece, F.greatest(F.lit(1), F.length(piece) - REACH + 1), F.lit(REACH)), rf"([^{_SP}]++)[{_SP}]*+$", 1))

        def right(piece):
            return F.lower(F.regexp_extract(F.substring(F.coalesce(piece, F.lit("")), F.lit(1), F.lit(REACH)), rf"^[{_SP}]*+([^{_SP}]++)", 1))

        both = F.zip_with(both, F.slice(pieces, 2, 1 << 30), lambda a, q: F.struct(a["m"].alias("m"), a["p"].alias("p"), left(a["p"]).alias("left"), right(q).alias("right")))
    else:
        both = F.transform(both, lambda a: F.struct(a["m"].alias("m"), a["p"].alias("p"), F.lit("").alias("left"), F.lit("").alias("right")))
    return F.transform(F.filter(both, lambda a: a["m"].isNotNull()), lambda a, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(a["p"]).cast("long").alias("gap"), a["m"].alias("match"), a["left"].alias("left"), a["right"].alias("right")))


def matches_of(docs: DataFrame) -> DataFrame:
    """Every rule match and identifier-like run, with its place: row, doc_id,
    text_key, kind, start, end (code points), match, left, right; a text
    without any has one row of nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))
    text, digit = F.col("text"), F.col("text").rlike("[0-9]")
    every = [_found(k, RULES[k], text, digit & (text.contains(HINTS[k]) if HINTS[k] else F.lit(True)) if k != "email" else text.contains("@")) for k in KINDS]
    every.append(_found("run", RUN, text, text.rlike("[0-9@]")))
    rows = docs.select("row", "doc_id", "text_key", F.explode_outer(F.concat(*every)).alias("m")).select("row", "doc_id", "text_key", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match").cast("long")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(upto))
    ok = F.lit(True)
    for k in KINDS:
        ok = F.when(F.col("kind") == k, valid(k, F.col("match"))).otherwise(ok)
    return rows.select("row", "doc_id", "text_key", F.when(ok, F.col("kind")).alias("kind"), (F.col("end") - size).alias("start"), "end", "match", "left", "right")


def unseen(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, turns: int = TURNS) -> DataFrame:
    """Runs that no rule matches but sure patterns do: row, doc_id, text_key,
    kind, start, end.

    A pattern's confidence in a kind is the mean, over its instances, of how
    sure each is of that kind (1 for seeds); it counts only with `support`
    texts with seeds.  A run's is 1 - the product of what its sure patterns
    leave open.  Both need `confidence`.
    """
    # a rule match belongs to the run that began last at or before it
    order = Window.partitionBy("row").orderBy("start", F.expr("kind <> 'run'")).rowsBetween(Window.unboundedPreceding, 0)
    placed = found.filter("kind is not null").withColumn("run", F.last(F.when(F.col("kind") == "run", F.col("start")), True).over(order))
    inside = F.when(F.col("kind") != "run", F.col("kind"))
    runs = placed.filter("run is not null").groupBy("row", "run").agg(
        F.min(inside).alias("low"), F.max(inside).alias("high"), F.max("end").alias("last"),
        *[F.max(F.when(F.col("kind") == "run", F.col(c))).alias(c) for c in ("doc_id", "text_key", "match", "left", "right", "end")])
    seed = F.when(F.expr("low = high"), F.col("low"))
    runs = cut_lineage(runs.select("row", "doc_id", "text_key", F.col("run").alias("start"), "end", "match", "left", "right", seed.alias("seed"),
                                   F.expr("low is null").alias("open")).filter("open or seed is not null"))
    edge = F.explode(F.filter(F.array(
        F.struct(F.lit("left").alias("side"), F.col("left").alias("w"), F.lit("").alias("v")),
        F.struct(F.lit("right").alias("side"), F.lit("").alias("w"), F.col("right").alias("v")),
        F.struct(F.when((F.col("left") != "") & (F.col("right") != ""), F.lit("both")).alias("side"), F.col("left").alias("w"), F.col("right").alias("v"))),
        lambda p: p["side"].isNotNull() & ((p["w"] != "") | (p["v"] != ""))))
    edges = runs.select("row", "start", "text_key", "seed", "open", edge.alias("p")).select("row", "start", "text_key", "seed", "open", F.xxhash64("p").alias("pattern"))
    # only patterns with enough seed texts can ever be sure
    able = edges.filter("seed is not null").groupBy("pattern", "seed").agg(F.countDistinct("text_key").alias("texts")).filter(F.col("texts") >= support)
    able = cut_lineage(able.select("pattern").distinct())
    edges = cut_lineage(edges.join(able, "pattern", "left_semi"))
    seeds = edges.filter("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(
        F.count("*").alias("n_seed"), F.countDistinct("text_key").alias("texts")).filter(F.col("texts") >= support)
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = cut_lineage(seeds.join(size, "pattern"))
    open_edges = cut_lineage(edges.filter("open").select("row", "start", "pattern"))
    sure = None
    for _ in range(turns):
        score = seeds.withColumn("more", F.lit(0.0))
        if sure is not None:
            gained = open_edges.join(sure, ["row", "start"]).groupBy("pattern", "kind").agg(F.sum("p").alias("gain"))
            score = seeds.join(gained, ["pattern", "kind"], "left").withColumn("more", F.coalesce("gain", F.lit(0.0)))
        patterns = cut_lineage(score.select("pattern", "kind", ((F.col("n_seed") + F.col("more")) / F.col("n")).alias("c")).filter(F.col("c") >= confidence))
        if patterns.isEmpty():
            break
        left_open = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("c"))))
        sure = cut_lineage(open_edges.join(patterns, "pattern").groupBy("row", "start", "kind").agg((1 - F.exp(left_open)).alias("p"))
                           .filter(F.col("p") >= confidence))
    if sure is None:
        return runs.limit(0).select("row", "doc_id", "text_key", F.col("seed").alias("kind"), "start", "end")
    best = sure.groupBy("row", "start").agg(F.max(F.struct(F.col("p"), F.col("kind"))).alias("b")).select("row", "start", "b.kind")
    # closing punctuation is not part of an identifier
    tail = F.length("match") - F.length(F.regexp_replace("match", r"[.,;:!?)\]}\"']++$", ""))
    return runs.join(cut_lineage(best), ["row", "start"]).select("row", "doc_id", "text_key", "kind", "start", (F.col("end") - tail).alias("end")).filter("end > start")


def find_pii(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, turns: int = TURNS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text_key, base and
    more: arrays of (start, rank, kind, end) of the rules' spans and of those
    the patterns add, sorted.

    A null text counts as empty and has none; a null or repeated doc_id is
    carried through; other columns are ignored.  Offsets count code points.
    """
    found = cut_lineage(matches_of(docs))
    added = unseen(found, support, confidence, turns).withColumn("base", F.lit(False))
    base = found.select("row", "doc_id", "text_key", F.when(F.col("kind") != "run", F.col("kind")).alias("kind"), "start", "end", F.lit(True).alias("base"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct(F.col("start"), rank.alias("rank"), F.col("kind"), F.col("end"))
    return base.unionByName(added).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"),
        F.sort_array(F.collect_list(F.when(F.col("base") & F.col("kind").isNotNull(), span))).alias("base"),
        F.sort_array(F.collect_list(F.when(~F.col("base"), span))).alias("more")).drop("row")


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, **how) -> DataFrame:
    """`docs` with every span in text replaced by [KIND]; overlapping spans
    are replaced together, by the kind of the first.  n_chars, where there is
    such a column, follows the text.  Texts meet their spans by two 64-bit
    hashes (128 bits), and only texts with spans meet the list of spans; other
    rows and columns, whatever their names, pass unchanged."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = F.xxhash64(text), F.xxhash64(F.lit(17), text)
    free = max(map(len, docs.columns)) * "_"             # longer than any column's name with a letter before it
    key, key2, spans_of = (f"{n}{free}" for n in ("k", "l", "s"))
    # the second hash goes where find_pii carries an id along
    spans = find_pii(docs.select(keys[1].alias("doc_id"), "text"), **how).withColumnsRenamed({"text_key": key, "doc_id": key2})
    by = [key, key2]
    spans = spans.select(*by, F.concat("base", "more").alias("s")).filter("size(s) > 0").dropDuplicates(by)
    spans = spans.select(*by, F.explode("s").alias("s")).select(*by, "s.*")
    # overlapping spans become one; each knows where the one before it ended
    so_far = Window.partitionBy(*by).orderBy("start", "rank", "end")
    spans = spans.withColumn("new", (F.col("start") >= F.coalesce(F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(so_far)).groupBy(*by, "island").agg(
        F.min(F.struct("start", "rank", "kind")).alias("first"), F.max("end").alias("stop"))
    spans = spans.withColumn("after", F.coalesce(F.lag("stop").over(Window.partitionBy(*by).orderBy("island")), F.lit(0).cast("long")))
    spans = cut_lineage(spans.groupBy(*by).agg(F.sort_array(F.collect_list(
        F.struct("island", "after", F.col("first.start").alias("start"), "stop", F.col("first.kind").alias("kind")))).alias(spans_of)))

    both = docs.withColumn(key, keys[0]).withColumn(key2, keys[1]).join(spans, by, "left")

    def between(after, until):
        return F.substring(F.col("text"), (after + 1).cast("int"), (until - after).cast("int"))

    done = F.concat(F.array_join(F.transform(spans_of, lambda s: F.concat(between(s["after"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))), ""),
                    between(F.element_at(spans_of, -1)["stop"], F.length("text")))
    both = both.withColumn("text", F.when(F.col(spans_of).isNotNull(), done).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col(spans_of).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])
