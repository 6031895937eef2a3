"""Source divergence audit: how the words of each source differ from those of the others and of its language.

Two passes over all whole texts. The first counts exactly in how many documents of its language each term stands; terms
in at least ``min_docs`` are kept. The second counts the occurrences of kept terms by Aho-Corasick automata (pyahocorasick)
over texts in which all but letters is a space, each term padded by a space on both sides, so that only whole terms match.
The vocabulary grows with the corpus, so it is dealt into slices of a bounded number of bytes; each slice is one automaton
for each language, sent to all tasks, and the texts are read once for each slice.

What a source lacks is not counted term by term: a term without occurrences has the same rate for the whole source, so the
sparse postings (terms with occurrences) and that base rate give every sum over all kept terms exactly, in whole numbers.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

#: Documents of its language that a kept term is in, ranks of distinctive terms, added to every count, scale of the rates.
MIN_DOCS, TOP_TERMS, ADDED, SCALE = 30, 50, 5, 1_000_000_000
#: Bytes of terms in a slice of the vocabulary. An automaton has at most a node a byte, of some fifty bytes.
SLICE_BYTES = 4 << 20
#: Entries that a task holds before it hands its counts on; bytes of text in one go of an automaton.
HELD, STRETCH = 300_000, 1 << 20

#: All bytes but those of letters and of characters beyond ASCII become spaces; A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _rows(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    empty = F.lit("")
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source"), F.coalesce(F.col(text_col), empty).cast("binary").alias("body"))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """``lang, term, docs``: in how many rows of ``lang, body`` each term stands. A task hands on partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            langs, terms = [k[0] for k in held], [k[1] for k in held]
            made = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()), pa.array(list(held.values()), pa.int64())], names=["lang", "term", "docs"])
            held.clear()
            return made

        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update((lang, term) for term in set(body.translate(FOLD).split()))
                if len(held) > HELD:
                    yield out()
        yield out()

    counted = rows.select("lang", "body").mapInArrow(run, "lang string, term binary, docs long")
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(rows: DataFrame, min_docs: int = MIN_DOCS, slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, int]:
    """``lang, term, docs, term_id, slice`` of the kept terms, a written table, and the number of slices.

    No slice has more than ``slice_bytes`` but one that is a single longer term.
    """
    kept = document_frequencies(rows).filter(F.col("docs") >= min_docs).withColumn("term_id", F.monotonically_increasing_id())
    kept = written(kept, "vocabulary")
    total = kept.agg(F.sum(F.length("term") + 2)).first()[0] or 0
    slices = max(1, -(-total // max(1, slice_bytes // 2))) if total > slice_bytes else 1
    while True:
        dealt = kept.withColumn("slice", F.pmod(F.xxhash64("lang", "term"), F.lit(slices)).cast("int"))
        sizes = dealt.groupBy("slice").agg(F.sum(F.length("term") + 2).alias("bytes"), F.count(F.lit(1)).alias("terms"))
        if sizes.filter((F.col("bytes") > slice_bytes) & (F.col("terms") > 1)).isEmpty():
            return dealt, slices
        slices *= 2


_built: dict[str, dict[str, ahocorasick.Automaton]] = {}


def _automata(sent: Broadcast) -> dict[str, ahocorasick.Automaton]:
    """An automaton of padded terms for each language; a worker keeps that of the last slice. It gives places in the list of
    the slice's terms: an automaton's numbers have 32 bits, term ids have more as soon as the vocabulary has two partitions."""
    name, langs, terms, _ = sent.value
    if name not in _built:
        _built.clear()
        made: dict[str, ahocorasick.Automaton] = {}
        for at, (lang, term) in enumerate(zip(langs, terms, strict=True)):
            if lang not in made:
                made[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            made[lang].add_word(f" {term.decode('latin-1')} ", at)  # a character for each byte
        for one in made.values():
            one.make_automaton()
        _built[name] = made
    return _built[name]


def _stretches(body: bytes) -> Iterator[str]:
    """The folded text with a space at both ends, in parts that begin and end with one."""
    folded, at = b" " + body.translate(FOLD) + b" ", 0
    while at < len(folded) - 1:
        end = folded.find(b" ", min(at + STRETCH, len(folded) - 1))
        yield folded[at : end + 1].decode("latin-1")
        at = end


def occurrences(rows: DataFrame, kept: DataFrame, slices: int) -> DataFrame:
    """``lang, source, term_id, count`` of the kept terms that occur there; a written table."""
    spark, parts = rows.sparkSession, []
    for k in range(slices):
        part = kept.filter(F.col("slice") == k).select("lang", "term", "term_id").toArrow()  # at most SLICE_BYTES of terms
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, *[part.column(c).to_pylist() for c in range(3)]))

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            automata, held, size = _automata(sent), defaultdict(Counter), 0
            ids = sent.value[3]

            def out() -> pa.RecordBatch:
                flat = [(lang, source, ids[t], n) for (lang, source), c in held.items() for t, n in c.items()]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], kind) for i, kind in enumerate(kinds)], names=["lang", "source", "term_id", "count"])

            for batch in batches:
                for lang, source, body in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    if lang in automata:
                        mine = held[lang, source]
                        size -= len(mine)
                        for stretch in _stretches(body):
                            mine.update(t for _, t in automata[lang].iter(stretch))
                        size += len(mine)
                        if size > HELD:
                            yield out()
                            size = 0
            yield out()

        counted = rows.mapInArrow(run, "lang string, source string, term_id long, count long")
        parts.append(written(counted.groupBy("lang", "source", "term_id").agg(F.sum("count").alias("count")), "occurrences"))
        sent.destroy()
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _rate(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(SCALE * (count + ADDED) / (n + ADDED * v))`` in whole numbers of any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    quotient = F.call_function("div", wide(F.lit(SCALE)) * wide(count + ADDED), wide(n + v * ADDED))
    return F.lit(1) + quotient.cast("long")


def audit(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: every pair of sources of a language, and the terms that mark a source.

    ``pair``: ``item`` is another source of the language, ``value`` the sum over all kept terms of the differences of both
    rates (0 without kept terms). ``term``: ``item`` is one of the ``top_terms`` kept terms that stand out most over the
    rate in the language. Ranks count from 1, values downwards, then items in order of their bytes. Null texts, languages
    and sources are read as ''. Each row is a document, whatever its identifier; texts without terms make their source
    appear; other columns are not read. An empty table gives no rows.
    """
    rows = _rows(docs, text_col, lang_col, source_col)
    kept, slices = vocabulary(rows, min_docs, slice_bytes)
    counts = occurrences(rows, kept, slices)
    zero = F.lit(0).cast("long")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = rows.select("lang", "source").distinct().join(sizes, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("n", zero).alias("n"))
    groups = written(groups.withColumn("base", F.when(F.col("v") > 0, _rate(zero, F.col("n"), F.col("v"))).otherwise(zero)), "groups")
    postings = counts.join(groups, ["lang", "source"]).withColumn("p", _rate(F.col("count"), F.col("n"), F.col("v")))
    postings = written(postings.select("lang", "source", "term_id", "count", "p", "base"), "postings")
    out = _pairs(groups, postings).unionByName(_terms(kept, groups, postings, top_terms))
    return out


def _pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """Sums of differences of rates. With base rates a, b: v |a - b|, corrected for the terms of one of both, then of both."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    pairs = groups.join(other, "lang").filter("source != item")
    start = pairs.select("lang", "source", "item", (F.col("v") * F.abs(F.col("base") - F.col("other"))).alias("part_value"))
    # terms of one source at the other's base rate: equal rates of a source are taken together
    rates = postings.groupBy("lang", "source", "p", "base").agg(F.count(F.lit(1)).alias("times"))
    apart = F.abs(F.col("base") - F.col("other"))
    single = rates.join(other, "lang").filter("source != item")
    single = single.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (F.abs(F.col("p") - F.col("other")) - apart)).alias("part_value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "part_value")
    # terms of both
    left, right = (postings.select("lang", "term_id", *[F.col(c).alias(f"{c}_{k}") for c in ("source", "p", "base")]) for k in "ab")
    met = left.join(right, ["lang", "term_id"]).filter("source_a < source_b")
    more = F.expr("abs(p_a - p_b) - abs(p_a - base_b) - abs(p_b - base_a) + abs(base_a - base_b)")
    both = met.groupBy("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item")).agg(F.sum(more).alias("part_value"))
    parts = start.unionByName(single).unionByName(turned(single)).unionByName(both).unionByName(turned(both))
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("part_value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _terms(kept: DataFrame, groups: DataFrame, postings: DataFrame, top_terms: int) -> DataFrame:
    """The kept terms of each source by how far their rate lies over that in the language."""
    of_lang = groups.groupBy("lang").agg(F.max("v").alias("v"), F.sum("n").alias("n"))
    whole = postings.groupBy("lang", "term_id").agg(F.sum("count").alias("count")).join(of_lang, "lang")
    whole = whole.select("lang", "term_id", _rate(F.col("count"), F.col("n"), F.col("v")).alias("q"))
    over = postings.join(whole, ["lang", "term_id"]).filter("p > q").join(kept.select("lang", "term_id", F.col("term").cast("string").alias("item")), ["lang", "term_id"])
    over = over.select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = over.withColumn("rank", rank).filter(F.col("rank") <= top_terms)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


ORACLE = r"""
with docs as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
freq as (select lang, term from (select lang, unnest(list_distinct(terms)) as term from docs) group by lang, term having count(*) >= 30),
groups as (select distinct lang, source from docs),
sizes as (select g.lang, count(f.term)::hugeint as v from (select distinct lang from groups) g left join freq f on f.lang = g.lang group by g.lang),
occ as (select lang, source, term, count(*)::hugeint as n from (select lang, source, unnest(terms) as term from docs) join freq using (lang, term) group by all),
dense as (select g.lang, g.source, f.term, coalesce(o.n, 0) as n from groups g join freq f on f.lang = g.lang left join occ o on o.lang = g.lang and o.source = g.source and o.term = f.term),
rated as (
  select *, 1 + (1000000000 * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p,
    1 + (1000000000 * (sum(n) over (partition by lang, term) + 5)) // (sum(n) over (partition by lang) + 5 * v) as q from dense join sizes using (lang)),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.f, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source != b.source
  left join (select x.lang, x.source as a, y.source as b, sum(abs(x.p - y.p)) as f from rated x join rated y on x.lang = y.lang and x.term = y.term and x.source != y.source group by all) s
    on s.lang = a.lang and s.a = a.source and s.b = b.source),
marks as (select lang, source, term as item, (p - q)::bigint as value from rated where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from marks) where rank <= 50
"""
