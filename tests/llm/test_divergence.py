"""Divergence of sources against counts in plain Python."""

import collections
import random
import re

import compare

from voxframe.llm import divergence as D
from voxframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, term string, word int, n long, value double"


def brute(docs, min_docs=10, top=10):
    groups, in_docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups[lang or "", source or ""].update(terms)
        in_docs[lang or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        mine = {s: c for (l, s), c in groups.items() if l == lang}
        whole = sum(mine.values(), collections.Counter())

        def share(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in mine.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        order = lambda rows: enumerate(sorted(rows, key=lambda r: (-r[1], r[0].encode())), 1)
        for s in mine:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if mine[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", i, v, r) for r, (i, v) in order(pairs)}
            out |= {(lang, s, "term", i, v, r) for r, (i, v) in order(terms) if r <= top}
    return out


def rows_of(df):
    return [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]


def check(spark, docs, **more):
    df = spark.createDataFrame([(i, *d, "x", 1, 2, 3.0) for i, d in enumerate(docs)], SCHEMA)
    got = rows_of(D.audit(df, **more))
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, **more)
    return got


def test_against_brute_force(spark):
    random.seed(5)
    words = [f"w{'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(150)] + ["Ünder", "ÜNDER", "日本", "it's", "A1b"]
    docs = []
    for _ in range(400):
        hot = random.random() < 0.4
        n = random.choice([0, 1, 3, 30, 120])
        text = " ".join(words[int(random.random() ** 2 * len(words))] for _ in range(n))
        docs.append((text, "en" if hot else random.choice(["de", "en", None, ""]),
                     "hot" if hot else random.choice(["a", "b", "c", "d", None, "é"])))
    docs += docs[:40]  # repeated rows count each time
    check(spark, docs)
    check(spark, docs, min_docs=1, top=3)


def test_no_kept_terms(spark):
    got = check(spark, [("one", "xx", "a"), (None, "xx", "b"), ("", None, None), ("1 2 3", "yy", "a")])
    assert got and all(r[2] == "pair" and r[4] == 0 for r in got)


def test_ties_and_long_texts(spark):
    same = "tie tak tok " * 10
    docs = [(same, "en", s) for s in "abc" for _ in range(10)] + [("tak " * 200_000, "en", "a"), ("zeta " * 9, "en", "c")]
    check(spark, docs)


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_terms_are_flushed(spark, monkeypatch):
    monkeypatch.setattr(D, "FLUSH", 5)
    check(spark, [("aa bb cc dd ee ff gg hh " * 2, "en", s) for s in "ab" * 10])


def test_probability_beyond_a_long(spark):
    from pyspark.sql import functions as F

    big = 20_000_000_000
    row = spark.range(1).select(D.probability(F.lit(big), F.lit(3 * big), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (big + 2) // (3 * big + 14)


def test_query_equals_sql(spark):
    got = compare.spark_rows(QUERIES["op12_divergence"](spark, SF))
    want = compare.sql_rows(compare.connect(SF), ORACLES["op12_divergence"])
    assert got[1] and compare.difference(got, want) is None
