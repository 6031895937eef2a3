"""Substring dedup against brute force over windows of the input."""

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.llm import substrings


def brute(rows, width):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text) rows."""
    worded = [(k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, w in worded:
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            if k is not None and (g not in first or k < first[g]):
                first[g] = k
    out = []
    for k, w in worded:
        gone = set()
        for i in range(len(w) - width + 1):
            if k is not None and first[tuple(w[i : i + width])] < k:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if k is None else k, len(w), len(gone), sha256(kept).hexdigest()))
    return sorted(out)


def prose(rng, n, pool=400):
    return [f"{rng.choice('abcdeéß')}{rng.randrange(pool)}" for _ in range(n)]


def odd_rows(rng, width):
    passage, other = prose(rng, 3 * width), prose(rng, width)
    rows = []
    for k in range(60):
        text = prose(rng, rng.randint(0, 4 * width))
        at = rng.randint(0, len(text))
        kind = k % 6
        if kind == 0:
            text[at:at] = passage
        elif kind == 1:
            cut = rng.randint(0, width)
            text[at:at] = passage[cut : cut + 2 * width - rng.randint(0, 3)]
        elif kind == 2:
            text[at:at] = other[: width - k % 2]
        elif kind == 3:
            text = prose(random.Random(5), 5 * width)
            text[rng.randrange(len(text))] = "changed"
        rows.append((k * 3 % 61, " ".join(text) if kind != 4 else "\n ".join(text) + "\x0b"))
    whole = prose(rng, 2 * width + 1)
    rows += [(100 + k, " ".join(whole)) for k in range(5)] + [(100, " ".join(whole)), (100, " ".join(whole[1:]))]
    rows += [(200, "ha " * (6 * width)), (201, "ha " * (9 * width) + "end"), (199, "ha " * (width - 1)), (202, "x " + "ha " * (5 * width))]
    rows += [(None, " ".join(whole)), (None, None), (300, None), (301, ""), (302, " \t\n"), (303, "a b c " * width), (304, "a b c " * width), (305, "a\x1cb c " * width)]
    return rows


@pytest.mark.parametrize("width", [50, 5])
def test_removed_words_equal_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(substrings, "STRETCH", 90)
    monkeypatch.setattr(substrings, "LONGEST", 17)
    rows = odd_rows(random.Random(width), width)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({"key": F.lit(1), "row": F.lit("r"), "spans": F.lit(None).cast("string"), "body": F.lit(2.5)})
    got = substrings.remove_repeats(docs, width)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = brute(rows, width)
    assert sorted((-1 if r.doc_id is None else r.doc_id, *list(r)[1:]) for r in got.collect()) == want
    assert sum(0 < w[2] < w[1] for w in want) > 10 and sum(w[2] == w[1] > 0 for w in want) > 3


def test_super_kmers_cover_each_window_once_and_travel_far():
    words = [w.encode() for w in prose(random.Random(1), 5000, 100_000)]
    key, start, n, one, _ = substrings.super_kmers(words)
    assert start.tolist() == [0, *np.cumsum(n)[:-1].tolist()] and n.sum() == 5000 - 49
    assert n.mean() > 12 and len(set(one.tolist())) == len(key)
    again = substrings.super_kmers([b"before", *words[1000:1200], b"after"])
    assert len(set(again[0].tolist()) - set(key.tolist())) <= 2
    assert all(len(x) == 0 for x in substrings.super_kmers(words[:49]))


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    assert [r.n_words for r in substrings.remove_repeats(docs).collect()] == [1]
