"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stopwise.llm import variants

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = counted(rows)
    near = defaultdict(list)
    for a in n:
        for b in n:
            if a != b and one_edit(a, b):
                near[a].append(b)
    form = {}
    for a, of in near.items():
        best = min(of, key=lambda b: (-n[b], b))
        if n[best] >= 10 * n[a]:
            form[a] = best
    out = []
    for a in n:
        root = a
        while root in form:
            root = form[root]
        out.append((a, n[a], len(near[a]), form.get(a), n[form[a]] if a in form else None, root))
    return sorted(out)


def odd_rows():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeéÿÀ×") for _ in range(rng.randint(7, 11))) for _ in range(25)]
    words = []
    for w in base:
        words += [w] * rng.choice([300, 40, 4])
        for _ in range(12):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            v = w[:at] + (rng.choice("abzÀ") if kind else "") + w[at + (kind < 2) :]
            words += [v] * rng.choice([2, 3, 30])
    words += ["aaaaaaaa"] * 50 + ["aaaaaaa"] * 5 + ["aaaaaaaaa"] * 500 + ["Straße"] * 3 + ["ŠKODAÀÉÈabcdef"] * 4
    rng.shuffle(words)
    glue = [" ", "1", "Ā", "-", "\n", "_", "中"]
    rows = [(k, "".join(w + rng.choice(glue) for w in words[k::40])) for k in range(40)]
    return rows + [(3, None), (4, ""), (None, " ".join(base[:3])), (5, "short words only"), (6, "longer" * 3000 + " " + "longer" * 3000 + "x"), (7, "longer" * 3000 + " " + "longer" * 3000 + "x"), (7, rows[7][1])]


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 100)
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"word": F.lit(1), "n": F.lit("x"), "key": F.lit(None).cast("int")})
    got = variants.group_variants(docs)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert any(w[3] and w[5] != w[3] for w in want) and sum(w[2] > 0 for w in want) > 50


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    assert variants.group_variants(docs.limit(0)).count() == 0 and variants.group_variants(docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("abcéÿ", min_size=1, max_size=12), st.integers(0, 11), st.sampled_from("abcéÿ"))
def test_one_edit_keeps_two_bands(word, at, letter):
    """The pigeonhole of the module: what each edit leaves equal in the masks."""
    mask = lambda w: [sum((w.count(c) & 1) * variants.BIT[ord(c)] for c in set(w)) & b for b in variants.BANDS]
    third = lambda w: [mask(w[k::3]) for k in range(3)]
    at %= len(word)
    replaced, shorter = word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :]
    assert sum(x == y for x, y in zip(third(word), third(replaced), strict=True)) >= 2
    assert sum(x == y for x, y in zip(mask(word), mask(shorter), strict=True)) == 2
    middle = len(word) // 2
    assert word[middle:] == shorter[middle - 1 :] if at < middle else word[:middle] == shorter[:middle]
