import random
import re

import pytest
from pyspark.sql import functions as F

from strata.llm.bootstrap_pii import RULES, find_pii, joined, redact
from tests.llm.cases import SCHEMA, docs_of, no_docs, odd_docs, rows

#: FIXED VALUES: the rules as plain patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def base_of(found):
    return {r.doc_id: r.s for r in found.select("doc_id", joined(F.col("base")).alias("s")).collect()}


def test_rules_match_as_the_plain_patterns(spark):
    r = random.Random(4)
    alphabet = ["a", "B", "9", "4", "255", "1.2.3.4", "@", "@x.co", ".", "-", " ", "+", "+1 ", "(", ")", "_", "%", "é", "😀", "4111 1111 1111 1111", "555-0199", "\n"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(600)]
    texts += ["a@b.c_d@e.f", "a@b.c@d.e", "@a.b", "a@b", "1.2.3.4.5.6.7.8", "01.002.0255.0", "256.1.1.1", "+1 (555) 555-0100.", "😀😀 x@y.zz", "4111111111111111", "4111-1111-1111-1112", "4" * 30, "+" + "1 " * 30]
    got = base_of(find_pii(docs_of(spark, texts)))
    for k, t in enumerate(texts):
        assert got[k] == brute(t), t


def test_long_runs_are_read_once(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "x.y@" + "a." * 100_000 + "b", "9 " * 20_000, "+1" + " 1" * 20_000]
    got = base_of(find_pii(docs_of(spark, texts)))
    assert got[0] == got[1] == got[5] == got[6] == "" and got[4] == f"email:0:{len(texts[4])}"
    assert got[2].count("ip:") == 37_500 and got[2].startswith("ip:0:7,ip:8:15")


def test_odd_rows(spark):
    found = find_pii(odd_docs(spark))
    assert found.count() == len(rows())
    got = base_of(found)
    assert all(got[i] == brute(t or "") for i, t in [(r[0], r[1]) for r in rows()] if i is not None)
    assert find_pii(no_docs(spark)).count() == 0


def added(spark, texts, **how):
    found = find_pii(docs_of(spark, texts), **how)
    return {r.doc_id: r.s for r in found.select("doc_id", joined(F.col("more")).alias("s")).collect() if r.s}


def test_sure_patterns_find_unseen_identifiers(spark):
    seeds = [f"note {'x' * k} call +1 (555) 555-01{k:02d} today" for k in range(30)]
    opened = ["please call 555-0123 today.", "call 0123,", "we saw 12 birds"]
    assert added(spark, seeds + opened) == {30: "phone:12:20", 31: "phone:5:9"}
    # too few seed texts, or a pattern that other runs share, is not sure
    assert added(spark, seeds[:4] + opened) == {}
    assert added(spark, seeds[:12] + [f"call {k} today" for k in range(100, 112)]) == {}


def test_patterns_gain_from_found_instances(spark):
    # "card" stands before 20 seeds and 3 others (0.87), "number" before 18 seeds, those 3 and 1 more (0.82 alone);
    # once the 3 are found, "number" is nearly as sure as they are (0.95) and finds the last
    seeds = [f"{'y' * k} card 4111 1111 1111 1111 end" for k in range(20)] + [f"{'z' * k} buy 4111 1111 1111 1111 number" for k in range(18)]
    opened = [f"{'v' * k} card 77-{k} number" for k in range(3)] + ["see 88-1 number"]
    got = added(spark, seeds + opened, confidence=0.85)
    assert set(got) == {38, 39, 40, 41} and got[38] == "card:6:10" and got[41] == "card:4:8"
    assert set(added(spark, seeds + opened, confidence=0.85, turns=1)) == {38, 39, 40}


def test_redaction(spark):
    docs = docs_of(spark, ["mail a.b@c.de, or 1.2.3.4!", "a 1.2.3.4@x.yy, 4111 1111 1111 1111 end", "nothing here", None, "😀 x@y.zz 😀"]).withColumn("n_chars", F.lit(7)).withColumn("row", F.lit("r"))
    got = {r.doc_id: r for r in redact(docs).collect()}
    assert got[0].text == "mail [EMAIL], or [IP]!" and got[0].n_chars == len(got[0].text) and got[0].row == "r"
    assert got[2].text == "nothing here" and got[2].n_chars == 7 and got[3].text is None and got[4].text == "😀 [EMAIL] 😀"
    assert got[1].text == "a [EMAIL], [CARD] end"
    odd = odd_docs(spark)
    assert redact(odd).columns == odd.columns and redact(odd).count() == len(rows()) and redact(no_docs(spark)).count() == 0


def test_redaction_with_clashing_columns(spark):
    clash = ("_spans", "_key", "text_key", "s", "k", "start", "end", "kind", "island", "base", "a.b")
    docs = docs_of(spark, ["mail a.b@c.de!", "clean", "mail a.b@c.de!"])
    for c in clash:
        docs = docs.withColumn(c, F.lit("kept"))
    got = redact(docs).collect()
    assert redact(docs).columns == docs.columns and sorted(r.text for r in got) == ["clean", "mail [EMAIL]!", "mail [EMAIL]!"]
    assert all(r[c] == "kept" for r in got for c in clash)


@pytest.mark.parametrize("kind", list(PLAIN))
def test_all_kinds_have_a_rule(kind):
    assert kind in RULES and len(SCHEMA) > 2
