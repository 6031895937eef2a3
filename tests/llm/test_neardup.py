"""Near-duplicates against brute force over all pairs of sets."""

import random

from stopwise.llm import components, neardup


def brute(rows, width, percent):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def test_large_group_of_near_copies_and_chains(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = [(k, " ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5, 6, 8])))) for k in range(260)]
    other = base[:75] + [f"v{rng.randrange(400)}" for _ in range(75)]  # half the passage, another end
    rows += [(1000 + k, " ".join(edited(rng, other, rng.choice([0, 1, 2, 4, 7])))) for k in range(60)]
    rows += [(1100 + k, " ".join(base[: 150 - k])) for k in range(45)]  # ever shorter beginnings
    chain = [f"c{k}" for k in range(120)]
    for k in range(12):  # each a few words away from the one before
        chain = chain[:]
        chain[10 * (k % 12)] = f"d{k}"
        rows.append((2000 + k, " ".join(chain)))
    rows += [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "One two"), (3004, "one TWO"), (3005, "one two three"), (3006, "ÄB cd"), (3007, "äb cd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 4, 80).collect()}
    assert got == brute(rows, 4, 80)


def footers(n, spread=0):
    """Documents of 100 shared words, 18 own ones and one of three footers of 16 words: no two are a link."""
    rng = random.Random(n)
    shared = [f"s{k}" for k in range(100)]
    foot = [[f"f{j}_{k}" for k in range(16)] for j in range(3)]
    return [(k, " ".join(shared + [f"o{k}_{j}" for j in range(18 + rng.randint(0, spread))] + foot[k % 3])) for k in range(n)]


def test_hot_passage_gives_no_pairs(spark, monkeypatch):
    seen, likely = [], neardup._likely

    def counting(pairs, signed, least):
        seen.append(pairs.count())
        return likely(pairs, signed, least)

    monkeypatch.setattr(neardup, "_likely", counting)
    for spread in (0, 6):
        made = []
        for n in (200, 400):
            seen.clear()
            got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(footers(n, spread), "doc_id long, text string"), 4, 80).collect()}
            assert got == {k: k for k in range(n)}
            assert sum(seen[1:]) <= n  # past the small buckets of bands, of 19 partners a member at most, nothing is compared
            made.append(seen[0])
        assert made[-1] <= 2.5 * made[-2], made


def test_group_within_a_hot_passage_is_found(spark):
    rng = random.Random(4)
    rows = footers(120)
    inner = rows[0][1].split()[:100] + [f"i{k}" for k in range(34)]  # as far from the others, but near copies of each other
    rows += [(1000 + k, " ".join(edited(rng, inner, rng.choice([0, 1, 2, 3])))) for k in range(70)]
    halves = [f"h{k}" for k in range(200)]  # parts of one text, each near its neighbours alone
    rows += [(2000 + k, " ".join(halves[k : k + 120])) for k in range(80)] + [(2999, " ".join(halves))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 4, 80).collect()} == brute(rows, 4, 80)


def test_filter_that_lets_all_pass_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup._sets, "__defaults__", (1 << 12,))
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    rows = [(k, " ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 5, 7])))) for k in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == brute(rows, 4, 80)


def test_rounds_to_the_last_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 0)  # nothing is compared in full before the last round
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup, "LATER_SMALL", 3)
    rng = random.Random(10)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = [(k, " ".join(edited(rng, base, rng.choice([1, 2, 3, 4, 5, 6, 7])))) for k in range(90)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == brute(rows, 4, 80)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text, 1, b"x"), (5, text, 2, b"y"), (7, text, 3, b"z"), (None, text, 4, b""), (9, None, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int, same binary")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(-1, -1, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True)]
    kept = neardup.keep_firsts(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (201, None), (301, 300), (300, 301)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {300: 300, 301: 300}
