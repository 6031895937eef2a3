"""Quality rules, sharding, mixing and fingerprints: brute force on small tables, odd rows, no Python in their plans."""

import math
import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stopwise.llm import fingerprint, mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "a b a b a b a", "x\nx\n\nx\ny", "ä#ö %% <b> & | * $", "é" * 30, "w " * 4000, "a b c " * 40 + "tail\x0bv\x0cf\rr"]


def docs(spark, n=60):
    rng = random.Random(2)
    make = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200)))
    rows = [(k, ODD[k] if k < len(ODD) else make(), rng.choice(["en", "de"]), f"s{k % 3}", k) for k in range(n)]
    rows += [(None, "null id", None, None, 0), (20, rows[20][1], "en", "s0", 1), (20, rows[20][1], "en", "s0", 1), (21, "other text", "en", "s0", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int")


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_base_statistics(spark):
    got = sorted((tuple(r) for r in quality.judge(docs(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    want = []
    for r in docs(spark).collect():
        t = r.text or ""
        w = WORD.findall(t)
        tri, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for i in range(len(w) - 2):
            if tri[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == sorted(want, key=str)


def test_false_neighbours_are_done_again(spark, monkeypatch):
    monkeypatch.setattr(quality, "_POS_BITS", 60)  # four bits of hash: many false neighbours
    rows = [(k, ("a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2 if k else "a b c d e f g h i j k l m n o p a b c q").strip()) for k in range(2)]
    got = quality.with_repeated_words(spark.createDataFrame(rows, "id int, t string").withColumn("w", F.split("t", " ")), "w", "n").orderBy("id").collect()
    assert [r.n for r in got] == [6, 52]


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9)))
    text = lambda junk: " ".join(word() + (rng.choice(["###", "%%%"]) if junk else "") for _ in range(150))
    rows = [(k, text(k % 12 == 0), "en" if k % 2 else "de", f"s{k % 2}") for k in range(600)] + [(1000, text(False), "fr", "rare"), (1001, text(False), None, None)]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id for r in judged.filter("not kept").collect()} == {k for k in range(0, 600, 12)}
    kept = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert kept.count() == 552 and len(kept.columns) == 4


def exact_mcd(x, starts=60):
    """The least determinant over many random starts, exact concentration steps to the end, then the final estimate."""
    rng, half = np.random.default_rng(0), math.ceil(len(x) * quality.CORE)
    floors = np.array(list(quality.FLOORS.values())) ** 2

    def moments(own, factor):
        cov = factor * np.cov(own.T, bias=True)
        cov[np.diag_indices(4)] = np.maximum(cov[np.diag_indices(4)], floors)
        return own.mean(0), cov

    distance = lambda m, c: np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
    best = None
    for _ in range(starts):
        m, c = moments(x[rng.choice(len(x), 8, False)], 1.0)
        for _ in range(30):
            m, c = moments(x[np.argsort(distance(m, c))[:half]], quality.core_factor(quality.CORE))
        if best is None or np.linalg.det(c) < np.linalg.det(best[1]):
            best = m, c
    return moments(x[distance(*best) <= quality.NEAR], quality.core_factor(quality.NEAR_SHARE))


@pytest.mark.parametrize("share", [0.0, 0.3])
def test_estimate_equals_exact_search(spark, share):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 4)) @ np.array([[0.2, 0.05, 0, 0], [0, 0.1, 0, 0.1], [0, 0, 0.3, 0], [0, 0, 0, 0.25]]) + [1.5, 0.2, 0.4, 0.3]
    x[: int(600 * share)] += [3, -2, 2, 4]
    rows = spark.createDataFrame([("en", "s", *map(float, r)) for r in x] + [("en", "other", 1.0, 0.0, 0.0, 0.0)] * 40, "g_lang string, g_source string, x_length double, x_symbols double, x_lines double, x_repeats double")
    found = {r.g_source: r for r in quality.estimates(rows).collect()}
    m, cov = exact_mcd(x)
    own = np.array([[found["s"][f"l_{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    assert [found["s"][f"m_{i}"] for i in range(4)] == pytest.approx(list(m), abs=0.03)
    assert own @ own.T == pytest.approx(cov, abs=0.25 * np.diag(cov).max())
    assert [found["other"][f"m_{i}"] for i in range(4)] == [1.0, 0.0, 0.0, 0.0] and found["other"]["l_33"] == quality.FLOORS["x_repeats"]


@pytest.mark.parametrize("axis", ["length", "symbols", "lines", "repeats"])
def test_each_statistic_can_reject_alone(spark, axis):
    rng = random.Random(axis)
    word = lambda n=(2, 9): "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(*n)))
    page = lambda ws: "\n".join(" ".join(ws[k : k + 10]) for k in range(0, len(ws), 10))
    rows = [(k, page([word() for _ in range(150)]), "en", "s") for k in range(200)]
    words = [word() for _ in range(150)]
    odd = {
        "length": page([word((18, 26)) for _ in range(150)]),
        "symbols": page([w + "##" if k % 3 == 0 else w for k, w in enumerate(words)]),
        "lines": page(words) + "\nx y\n" * 14,
        "repeats": page(words + [word() for _ in range(20)] + words[:45]),
    }[axis]
    judged = quality.judge(spark.createDataFrame([*rows, (1000, odd, "en", "s")], "doc_id long, text string, lang string, source string"))
    assert [(r.doc_id, r.base_failed) for r in judged.filter("not kept").collect()] == [(1000, False)]


def test_quality_of_an_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0
    d = docs(spark).withColumns({"q_row": F.lit(1), "d2": F.lit("x"), "g_lang": F.lit(None).cast("string")})
    out = quality.keep_good(d)
    no_python(out)
    assert out.columns == d.columns
    kept = Counter(tuple(r) for r in quality.judge(d).filter("kept").select("doc_id").collect())
    assert Counter((r.doc_id,) for r in out.collect()) == kept


def test_sharding(spark, tmp_path):
    d = docs(spark, 300)
    out = sharding.two_pass_shuffle(d, 7, bucket_bytes=4096)
    no_python(out)
    rows = out.collect()
    assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str((r.doc_id, r.text)) for r in d.collect())
    for shard in range(7):
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
    assert all(r.grown_shard in (r.shard, 7) for r in rows) and 0 < sum(r.grown_shard == 7 for r in rows) < 90
    again = sharding.two_pass_shuffle(d.repartition(5), 7, bucket_bytes=4096).collect()
    assert {(r.doc_id, r.shard, r.slot, r.text) for r in again} == {(r.doc_id, r.shard, r.slot, r.text) for r in rows}
    part = sharding.two_pass_shuffle(d.filter("doc_id < 50"), 7).collect()
    assert {(r.doc_id, r.shard) for r in part} <= {(r.doc_id, r.shard) for r in rows}
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.shard == 3]
    assert order != sorted(order, key=lambda x: x or -1)
    assert sharding.two_pass_shuffle(d.limit(0), 7).count() == 0


def test_sharding_law_by_brute_force(spark):
    unit = lambda key, seed, j: (xxhash64_of(key, seed, j) >> 11) * 2.0**-53

    def xxhash64_of(key, seed, j):  # Spark hashes column by column, each hash being the seed of the next
        h = xxhash.xxh64(key.to_bytes(8, "little", signed=True), seed=42).intdigest()
        for v in (seed, j):
            h = xxhash.xxh64(v.to_bytes(4, "little"), seed=h).intdigest()
        return h

    keys = [0, 1, 2, 7, -5, 10**12, *range(100, 160)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.shard_of(F.col("k"), 40, 17).alias("a"), sharding.shard_of(F.col("k"), 41, 17).alias("b")).collect()
    for r in rows:
        jumps = [j for j in range(1, 41) if unit(r.k, 17, j) * (j + 1) < 1]
        assert r.b == max(jumps, default=0) and r.a == max((j for j in jumps if j < 40), default=0)


def test_sharding_spreads_repeated_rows(spark):
    rows = [(1, "the same row")] * 400 + [(None, None)] * 50 + [(k, f"text {k}") for k in range(2, 100)]
    out = sharding.two_pass_shuffle(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2, bucket_bytes=1024).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    shard = {r.shard for r in out if r.doc_id == 1}
    assert len(shard) == 1 and max(Counter(r.bucket for r in out if r.doc_id == 1).values()) < 200
    for k in (0, 1):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))


def test_mixing(spark):
    d = docs(spark, 200).withColumn("mix_rate", F.lit(1))
    out = mixing.replicate(d, {"s0": 3.0, "s1": 1.0}, budget=4.0)
    no_python(out)
    rows = out.collect()
    rate = {r.source: r.mix_rate for r in rows}
    size = {s: sum(len((r.text or "").encode()) for r in d.collect() if r.source == s) for s in ("s0", "s1", "s2")}
    total = sum(len((r.text or "").encode()) for r in d.collect())
    assert set(rate) == {"s0", "s1"} and rate["s0"] == pytest.approx(0.75 * 4 * total / size["s0"])
    assert rows == sorted(rows, key=lambda r: r.mix_order) and out.columns[:5] == ["doc_id", "text", "lang", "source", "size"]
    n = Counter(r.doc_id for r in rows if r.source == "s0")
    assert np.mean([n[r.doc_id] for r in d.collect() if r.source == "s0"]) == pytest.approx(rate["s0"], rel=0.2)
    assert {r.mix_copy for r in rows if r.doc_id == 30} == set(range(1, n[30] + 1)) if 30 in n else True
    assert mixing.replicate(d.limit(0)).count() == 0 and mixing.replicate(docs(spark)).count() > 0


@pytest.mark.parametrize("mean", [0.0, 0.01, 0.7, 3.0, 60.0, 169.5, 171.0, 746.0, 800.0, 4000.0, 90_000.0])
def test_poisson_inverse(spark, mean):
    us = [1e-9, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999999, 0.0, 1 - 2**-48]
    rows = mixing.with_ladder(spark.createDataFrame([(u, mean) for u in us], "u double, m double"), "m")
    got = [r.k for r in rows.select(mixing.poisson_inverse(F.col("u")).alias("k")).collect()]
    ks = range(max(0, int(mean - 40 * math.sqrt(mean))), int(mean + 40 * math.sqrt(mean) + 60))
    total = np.cumsum([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean else float(k == 0) for k in ks])
    for u, k in zip(us[:-2], got, strict=False):
        want = ks[int((total <= u).sum())]
        assert abs(k - want) <= (1 if mean > 1000 and u == 1e-9 else 0)
    # the ends of the table, where double precision ends
    assert max(0, mean - 13 * math.sqrt(mean) - 31) <= got[-2] <= mean and mean <= got[-1] <= mean + 13 * math.sqrt(mean) + 31


def test_mixing_with_a_large_rate_varies(spark):
    rows = [(k, "small text", "tiny") for k in range(40)] + [(100, "x" * 400_000, "large")]
    out = mixing.replicate(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_n", F.lit("n")).withColumn("mix_digest", F.lit("d")), {"tiny": 1.0})
    assert {"mix_n", "mix_digest"} <= set(out.columns) and out.filter("mix_n = 'n' and mix_digest = 'd'").count() == out.count()
    rate = out.first().mix_rate
    n = np.array(list(Counter(r.doc_id for r in out.select("doc_id").collect()).values()))
    assert rate > 1000 and n.mean() == pytest.approx(rate, rel=0.03) and 0.5 < n.var() / rate < 2


def jaccard(a, b):
    x, y = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def full_samples(text):
    """All samples of a text as winning (term, level), every term's value computed in full."""
    h = lambda x: xxhash.xxh64(x.to_bytes(8, "little"), seed=42).intdigest()
    quarters = lambda x: [x >> 48, x >> 32 & 0xFFFF, x >> 16 & 0xFFFF, x & 0xFFFF]
    out = []
    for k in range(fingerprint.SAMPLES):
        best = None
        for word, n in Counter(WORD.findall(text)).items():
            a = h(xxhash.xxh64(word.encode(), seed=42).intdigest() ^ (fingerprint._STEP * (2 * k + 1) % (1 << 62)))
            b = h(a)
            u = [(x + y / 65536 + 2**-17) / 65536 for x, y in zip(quarters(a), quarters(b), strict=True)]
            r, log_c, beta = -math.log(u[0] * u[1]), math.log(-math.log(u[2] * u[3])), ((h(b) >> 11) + 0.5) * 2**-53
            level = math.floor(math.log(n) / r + beta)
            best = min(filter(None, (best, (log_c - r * (level - beta) - r, word, level))))
        out.append(best[1:])
    return out


def test_fingerprints_equal_full_sampling(spark):
    rng = random.Random(8)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(300)]
    texts = [" ".join(w if rng.random() > 0.06 * k else "new" + w for w in base[: 300 - 40 * k]) for k in range(7)] + ["one", "one two", "two " * 500]
    rows = fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    drawn = [full_samples(t) for t in texts]
    for r in rows:
        own, other = drawn[r.doc_id], drawn[(r.doc_id - 1) % len(texts)]
        assert r.near_next == np.mean([x == y for x, y in zip(own, other, strict=True)])


def test_fingerprints(spark):
    d = docs(spark, 80)
    out = fingerprint.fingerprints(d)
    rows = out.collect()
    no_python(out)
    seen = {}
    for r in d.collect():
        seen.setdefault((r.doc_id, r.text or ""), 0)
        seen[(r.doc_id, r.text or "")] += 1
    assert len(rows) == d.count()
    by_text = {}
    text_of = {}
    for k, t in seen:
        text_of.setdefault(k, []).append(t)
    order = sorted({r.doc_id for r in d.collect()}, key=lambda k: (k is not None, k or 0), reverse=True)
    errors = []
    for r in rows:
        if len(text_of[r.doc_id]) > 1:
            continue
        own = text_of[r.doc_id][0]
        after = text_of[order[(order.index(r.doc_id) + 1) % len(order)]]
        assert r.n_chars == len(own)
        if len(after) == 1:
            half = len(own) // 2
            edited = own[: len(own) - half] + after[0][:half]
            assert r.edited_sha256 == sha256(edited.encode()).hexdigest()
            if WORD.search(own) and WORD.search(edited):
                errors += [r.near_edited - jaccard(own, edited), r.near_next - jaccard(own, after[0])]
        assert by_text.setdefault(own, r.fingerprint) == r.fingerprint
        assert (r.fingerprint == "") == (WORD.search(own) is None)
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.08
    assert fingerprint.fingerprints(d.limit(0)).count() == 0
