"""The divergence audit against dense counts in plain Python and against its SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from merchlife.llm import divergence, queries
from verification.compare import difference, duckdb_on

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, p):
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        found = Counter(TERM.findall(text.translate(LOWER)))
        counts[lang, source].update(found)
        in_docs[lang].update(found.keys())
    out = []
    for lang in {lang for lang, _ in counts}:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= p.documents)
        sources = sorted(s for x, s in counts if x == lang)

        def rate(n, kept=kept):
            total = sum(n[t] for t in kept)
            return {t: 1 + p.scale * (n[t] + 1) // (total + len(kept)) for t in kept}

        q = rate(sum((counts[lang, s] for s in sources), Counter()))
        each = {s: rate(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((each[s][t] - each[o][t]) ** 2 // each[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((each[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and each[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, p.ranks)):
                out += [(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.fixture
def made():
    rng = random.Random(8)
    words = ["The", "the", "Ärger", "ärger", "übung", "日本", "a-b", "don't", "x1y", "zoo", "ZOO", "e\x00f", "tab\tbed", "[link]", "ß", "É"] + [f"w{chr(97 + i)}" for i in range(20)]
    return [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None, "Ü"]), " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for _ in range(120)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as n", "'t' as term", "2 as p", "3 as doc_id")


def test_audit_is_that_of_dense_counts(spark, made):
    rows = made + [("de", "only", None), ("de", "two", ""), ("de", "two", "12 34"), ("it", "a", "uno due"), ("it", "b", "uno " * 40), ("nl", "x", "een een"), *[("pt", s, "um dois " + s) for s in "abc" for _ in range(3)]]
    rows += [("en", "s1", "lorem ipsum " * 30_000)] * 3
    p = divergence.Params(ranks=5)
    assert sorted(tuple(r) for r in divergence.audit(frame(spark, rows), p).collect()) == brute(rows, p)
    again = divergence.audit(frame(spark, made), divergence.Params(ranks=5, held=1))  # tasks hand on after each document
    assert sorted(tuple(r) for r in again.collect()) == brute(made, p)


def test_empty_and_wordless_tables(spark):
    assert divergence.audit(frame(spark, [("a", "b", "c")]).limit(0)).count() == 0
    got = divergence.audit(frame(spark, [("a", "b", None), (None, None, "x"), ("a", "c", "1")])).collect()
    assert sorted(tuple(r) for r in got) == [("a", "b", "pair", "c", 0, 1), ("a", "c", "pair", "b", 0, 1)]


def test_counts_beyond_longs_times_the_scale(spark):
    df = spark.sql("select 90000000000000L as n, 95000000000000L as total, 7L as terms")
    assert df.select(divergence.weight("n", "total", "terms", 10**9)).first()[0] == 1 + 10**9 * (90000000000000 + 1) // (95000000000000 + 7)


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert difference(queries.QUERIES["op11_source_divergence"](spark, folder), duckdb_on(folder), queries.ORACLES["op11_source_divergence"]) is None
