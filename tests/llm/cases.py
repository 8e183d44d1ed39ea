"""Small awkward tables shared by the tests of this folder."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    # names that operators use inside or return
    *[T.StructField(n, T.StringType()) for n in ("row", "kind", "kept", "score", "component_id", "fingerprint", "h", "pos", "length", "_block", "n_chars")]])


def words(n, seed=0, base="w"):
    r = random.Random(seed)
    return [f"{base}{r.randrange(10_000)}" for _ in range(n)]


LONG = " ".join(words(20_000, 1)) + " " + "x" * 50_000


def rows():
    some = " ".join(words(60, 2))
    plain = [(1, some), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (5, LONG), (6, some), (7, some.upper()), (8, "one two"), (9, "Two words"), (10, "one two"),
             (None, "an unnamed text of six words"), (None, None), (11, "é ü ▁ a▁b  c   \x1c\x85 😀 <s> <|endoftext|>"), (12, some.replace(" ", "  \n"))]
    return [(*r, "en", *[None] * (len(SCHEMA) - 3)) for r in plain]


def odd_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
