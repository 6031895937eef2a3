"""The divergence audit against brute force, in one slice and in many."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stopwise.llm import divergence


def brute(rows, min_docs, top):
    """(lang, source, part, item, value, rank) of (lang, source, text) rows, term by term."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(low))) for lang, source, text in rows]
    df = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= min_docs:
            kept[lang].append(t)
    counts = defaultdict(Counter)
    for lang, source, terms in docs:
        for t in terms:
            counts[lang, source][t] += 1
            counts[lang][t] += 1
    sources = defaultdict(set)
    for lang, source, _ in docs:
        sources[lang].add(source)

    def rate(key, terms, t):
        return 1 + 10**9 * (counts[key][t] + 5) // (sum(counts[key][x] for x in terms) + 5 * len(terms))

    out = []
    for lang, of in sources.items():
        terms = kept[lang]
        p = {s: {t: rate((lang, s), terms, t) for t in terms} for s in of}
        q = {t: rate(lang, terms, t) for t in terms}
        for s in of:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode(), o) for o in of if o != s]
            marks = [(q[t] - p[s][t], t.encode(), t) for t in terms if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(marks)[:top])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)]
    return sorted(out)


def odd_rows():
    rng = random.Random(3)
    pool = [rng.choice(["Ab", "be", "ça", "Él", "日本", "x", "\U0001f600y"]) + rng.choice("aeiouÜ") * rng.randint(0, 2) for _ in range(60)]
    glue = [" ", "\n", "-", "'", "1", "  ", "\t", "\x00", "_"]
    make = lambda n: "".join(rng.choice(pool) + rng.choice(glue) for _ in range(n))
    rows = [("en", f"s{min(3, rng.randint(0, 9))}", make(rng.randint(0, 40))) for _ in range(90)]
    rows += [("de", "s1", make(30)), ("de", None, make(30)), (None, None, None), (None, "s9", ""), ("en", "", "12 34"), ("", "s2", make(5))]
    rows += [("en", "s3", make(2000))] + [("en", "s0", "same same words here")] * 20
    return rows


@pytest.mark.parametrize("slice_bytes", [1 << 20, 200])
def test_audit_equals_brute_force(spark, slice_bytes, monkeypatch):
    monkeypatch.setattr(divergence, "STRETCH", 64)
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    docs = docs.withColumns({"term": F.lit("x"), "body": F.lit(1), "v": F.lit(2), "base": F.lit(3)})
    got = divergence.audit(docs, min_docs=3, top_terms=4, slice_bytes=slice_bytes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute(rows, 3, 4)
    assert sorted(map(tuple, got.collect())) == want and {w[2] for w in want} == {"pair", "term"}


def test_vocabulary_of_many_partitions(spark):
    """Ids of terms pass 32 bits as soon as the vocabulary has a second partition."""
    rows = odd_rows()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "lang string, source string, text string")
        kept, _ = divergence.vocabulary(divergence._rows(docs, "text", "lang", "source"), 3)
        assert kept.agg(F.max("term_id")).first()[0] >= 1 << 32
        got = sorted(map(tuple, divergence.audit(docs, min_docs=3, top_terms=4).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows, 3, 4)


def test_slices_are_bounded_and_whole(spark):
    docs = spark.createDataFrame([("en", "s", f"aa bb cc {'z' * 300} w{chr(97 + k % 26)}") for k in range(60)], "lang string, source string, text string")
    kept, slices = divergence.vocabulary(divergence._rows(docs, "text", "lang", "source"), 2, 24)
    sizes = {r["slice"]: (r["b"], r["n"]) for r in kept.groupBy("slice").agg(F.sum(F.length("term") + 2).alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    assert slices > 4 and kept.count() == 30 and all(b <= 24 or n == 1 for b, n in sizes.values())


def test_nothing_kept_and_no_rows(spark):
    docs = spark.createDataFrame([("en", "a", "one"), ("en", "b", "two")], "lang string, source string, text string")
    assert sorted(map(tuple, divergence.audit(docs).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(docs.limit(0)).count() == 0


def test_rates_of_counts_beyond_a_long(spark):
    big = 4 * 10**12
    df = spark.createDataFrame([(big, 3 * big, 10**6)], "c long, n long, v long").select(divergence._rate(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert df.first()[0] == 1 + 10**9 * (big + 5) // (3 * big + 5 * 10**6)
