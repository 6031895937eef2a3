"""The pipeline's stages against its operators' own tables, and the whole chain against brute force on odd rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from stopwise.llm import common, neardup, quality
from stopwise.llm.tokens import default_file, encoder

from test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, SF)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    clean = stages["toxicity"](spark, good, SF)
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    gone = {r.doc_id for r in good.collect()} - {r.doc_id for r in clean.collect()}
    assert len(gone) <= 40 and len(gone & toxic) >= 0.6 * len(toxic & {r.doc_id for r in good.collect()})
    single = stages["near_duplicates"](spark, clean, SF)
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in neardup.near_duplicates(clean, 5, 80).filter("kept").collect()}
    mixed = stages["source_mixture"](spark, single, SF)
    for d in (good, clean, single, mixed):
        assert d.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in single.collect()}
    rows = stages["packing"](spark, mixed, SF).collect()
    assert sum(r.piece == 0 for r in rows) == mixed.count() and max(r.length for r in rows) <= 1024


def test_copies_go_whatever_their_identifiers(spark):
    text, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "wv")
    near = text.replace("w59", "x")
    rows = [(5, text, 1), (5, text, 2), (5, text, 2), (7, near, 3), (None, text, 4), (None, near, 5), (None, other, 6), (None, other, 6), (5, "one two three", 7), (9, None, 8), (None, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int")
    single = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    got = sorted((str(r.doc_id), r.text or "") for r in single.collect())
    assert single.columns == docs.columns
    assert got == sorted([("5", text), ("None", other), ("5", "one two three"), ("9", ""), ("None", "")])
    assert neardup.keep_single(docs.limit(0)).count() == 0


def test_quality_verdicts_are_of_rows_not_identifiers(spark):
    good, bad = " ".join(f"w{k}" for k in range(60)), "too short"
    rows = [(1, good, "en", "s"), (1, bad, "en", "s"), (None, good, None, None), (None, bad, None, None), (None, None, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", good), ("None", good)]


def odd_documents(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9)))
    prose = [" ".join(word() for _ in range(rng.randint(60, 140))) for _ in range(40)]
    near = prose[0].split()
    near[-1] = "other"
    rows = [(k, t, "en", f"s{k % 2}", k) for k, t in enumerate(prose)]
    rows += [(0, prose[0], "en", "s0", 90), (0, prose[0], "en", "s0", 90), (None, prose[0], None, None, 91), (50, " ".join(near), "en", "s1", 92)]
    rows += [(51, None, "en", "s0", 93), (52, "", None, "s0", 94), (53, " \n\t", "en", None, 95), (None, None, None, None, 96), (54, "too short", "en", "s0", 97), (55, "a b c " * 60, "de", "s1", 98)]
    rows += [(56, " ".join(word() for _ in range(4000)), "en", "s0", 99)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, q_row int").withColumns({"mix_n": F.lit(1), "row_key": F.lit("k"), "component_id": F.lit(None).cast("long"), "d2": F.lit(0.5)})


def test_whole_chain_over_odd_rows(spark):
    docs = odd_documents(spark)
    columns, texts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == columns
            docs = common.written(docs, name)
        texts[name] = Counter((r.doc_id, r.text) for r in docs.collect()) if name != "packing" else docs.collect()
    base = {(r.doc_id, r.text) for r in odd_documents(spark).collect() if len((r.text or "").split()) >= 50 and r.text[:6] != "a b c "}
    assert set(texts["quality_rules"]) <= base and len(texts["quality_rules"]) >= len(base) - 3
    # near duplicates by brute force over the rows that came in: one of each group, of the least identifier
    rows = [(k, t) for k, (_, t) in enumerate(texts["toxicity"].elements())]
    groups = {c for _, c in brute(rows, 5, 80).values()}
    assert sum(texts["near_duplicates"].values()) == len(groups) and set(texts["near_duplicates"]) <= set(texts["toxicity"])
    assert (0, texts_of(texts["near_duplicates"], 0)) in texts["near_duplicates"] and not {50, None} & {k for k, _ in texts["near_duplicates"]}
    # packing: every row's ids, in full, by the library
    tok = encoder(default_file("byte_bpe_50k.json")).tokenizer
    made = {}
    for r in sorted(texts["packing"], key=lambda r: (r.row_id, r.piece)):
        made.setdefault(r.row_id, (r.doc_id, []))[1].extend(r.ids)
    want = Counter((k, tuple([*tok.encode(t, add_special_tokens=False).ids, 2])) for k, t in texts["source_mixture"].elements())
    assert Counter((k, tuple(ids)) for k, ids in made.values()) == want
    placed = sorted((r.sequence_id, r.offset, r.length) for r in texts["packing"])
    for (s, o, n), (s2, o2, _) in zip(placed, placed[1:], strict=False):
        assert o2 == (o + n if s == s2 else 0) and o + n <= 1024


def texts_of(counted, doc_id):
    return next(t for k, t in counted if k == doc_id)


def test_whole_chain_over_an_empty_table(spark):
    docs = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
