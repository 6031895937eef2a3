"""MinHash near-duplicates: universal hash minima, banding, signature verification, full confirmation, components.

1. Every whole text becomes its set of word shingles (64-bit hashes) and 360 minima in 60 bands of six; documents with
   equal sets are one class, represented by the least identifier. At a similarity of 0.8 a pair shares no band with a
   chance of (1 - 0.8^6)^60, about 10^-8.
2. A bucket with few members outside its largest component gives the pairs of these with all (at first every document is a
   component, so these are all pairs of small buckets). Pairs whose minima agree too rarely are out (a pair at 0.8 with a chance of
   3 in 10^7, five standard errors), the others are confirmed on full sets.
3. A large bucket gives no pairs but those of each member with a pivot, the member that shares most buckets, or one that
   all members have from other buckets. The full overlap o = |x & p| and the rest x - p are kept. Of two members a, b,
   |a & b| <= min(o_a, o_b) + |rest_a & rest_b|. So a pair that is not joined yet can only be a link if min(o_a, o_b)
   reaches what a link needs, or if the rests share a shingle among their rarest ones: with the sizes known, all rests
   being in one order of rarity, the first shared shingle lies in a prefix whose length the sizes bound, shorter still on
   the smaller side. Each such shingle, and each class of sizes, is a new and smaller bucket, so step 2 follows again.
   Buckets that one component has to itself are dropped at once. As soon as the members outside the largest component of
   every bucket make few meetings with all of it (FEW for each document), or after LEVELS rounds however many they are,
   these are compared. No link is lost to the size of a group, and what its members share with its pivot makes no pairs.
4. Components of the links, by alternating large-star and small-star.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written
from .components import components, stars

BANDS, ROWS = 60, 6
#: Pairs whose minima agree this far below the threshold are not confirmed: five standard errors of 360 minima at 0.8.
SLACK = 0.105
#: Members outside a bucket's largest component up to which they meet all members; beyond, it is compared by way of a pivot: of the
#: buckets of bands, and of those of later rounds, in which most members are of one component.
SMALL, LATER_SMALL = 20, 64
#: Meetings, for each document, that a comparison in full may make: what is left is so compared as soon as it makes no more.
FEW = 4
#: Most rounds, by pivots but for the last; size classes of the members of a pivot, as a ratio; members of a pivot on which rarity is counted.
LEVELS, SIZE_STEP, RARITY_SAMPLE = 8, 1.05, 64
#: Bits of the filter of documents to confirm: sixteen for each, at most so many (8 MB). Beyond some ten million documents the
#: filter lets more of the others pass, up to all of them; their sets are made and dropped by the exact join that follows.
FILTER_BITS = 1 << 26


@lru_cache
def _family() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.uint64]:
    """Fixed random numbers: multipliers and offsets of the minima, byte values, band multipliers, power base."""
    rng = np.random.default_rng(20_240_229)
    draw = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    return draw(BANDS * ROWS) | np.uint64(1), draw(BANDS * ROWS), draw(256), draw(ROWS) | np.uint64(1), draw(1)[0] | np.uint64(5)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, grown as longer texts come."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        base = int(_family()[4])
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; of the whole sequence if it has fewer words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly the word breaks
    if not found:
        return np.empty(0, np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    raw = np.frombuffer(b" ".join(found), np.uint8)
    power, inverse = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_family()[2][raw] * power[: len(raw)], out=sums[1:])
    width = min(width, len(found))
    begin, end = (ends - lengths)[: len(found) - width + 1], ends[width - 1 :]
    return np.unique(_mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)))


def minima(found: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over the shingles, 32 bits each."""
    a, b = _family()[0][:, None], _family()[1][:, None]
    least = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for lo in range(0, len(found), 512):
        np.minimum(least, ((found[None, lo : lo + 512] * a + b) >> np.uint64(32)).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = _mix(least.reshape(BANDS, ROWS) + np.uint64(1)) * _family()[3][None, :]
    return _mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, same`` (a fingerprint of the set), ``bands, minima`` (low bytes) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows: list[list] = [[], [], [], []]
                for text in part.column(1).to_pylist():
                    found = shingles(text, width)
                    least = minima(found) if len(found) else None
                    values = (len(found), blake2b(found.tobytes(), digest_size=16).digest())
                    values += (None, None) if least is None else (band_keys(least), (least & np.uint64(255)).astype(np.uint8).tobytes())
                    for r, v in zip(rows, values, strict=True):
                        r.append(v)
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
                cols = [part.column(0), *[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "same", "bands", "minima"])

    schema = "doc_id long, n_shingles long, same binary, bands array<long>, minima binary"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def _likely(pairs: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """Adds the similarity ``guess`` that the minima of ``a`` and ``b`` show, and keeps pairs of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for k in (2, 3))
            guess = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(guess)], names=["a", "b", "guess"])
            yield out.filter(pa.array(guess >= least))

    one = signed.select(F.col("doc_id").alias("a"), F.col("minima").alias("m_a"))
    two = signed.select(F.col("doc_id").alias("b"), F.col("minima").alias("m_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "m_a", "m_b").mapInArrow(run, "a long, b long, guess double")


def _sets(docs: DataFrame, pairs: DataFrame, width: int, most_bits: int = FILTER_BITS) -> DataFrame:
    """``key, found``: the full sets, made again, of the documents of these pairs, and of few others.

    A Bloom filter of the identifiers, of bounded size, is sent to all tasks, so texts are not shuffled. Whoever joins the
    result by identifier is rid of the others.
    """
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "asked")
    bits = min(most_bits, max(1 << 12, 1 << (16 * asked.count()).bit_length()))
    one, two = F.xxhash64("key"), F.xxhash64(F.xxhash64("key"))
    places = [x.bitwiseAND(F.lit(bits - 1)) for h in (one, two) for x in (h, F.shiftrightunsigned(h, 32))]
    held = asked.select(F.explode(F.array(*places)).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found = held.toArrow()  # at most most_bits / 64 rows
    filled = np.zeros(bits // 64, np.uint64)
    filled[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    drop_written(asked)
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = np.ones(batch.num_rows, bool)
            for k in range(2, 6):
                at = batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64)
                passed &= (sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            some = batch.filter(pa.array(passed))
            for lo in range(0, some.num_rows, 500):
                part = some.slice(lo, 500)
                found = [shingles(t, width).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["key", "found"])

    known = docs.filter("key is not null").select("key", "body", *[p.alias(f"at_{k}") for k, p in enumerate(places)])
    return known.mapInArrow(sets, "key long, found binary")


def _measured(pairs: DataFrame, sets: DataFrame, rest: bool) -> DataFrame:
    """``a, b, n_a, n_b, both`` (sizes and overlap of the full ``sets``) and, with ``rest``, the shingles of ``b`` not in ``a``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows: list[list] = [[], [], [], []]
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                    values = (len(x), len(y), int(common.sum()), y[~common].view(np.int64) if rest else None)
                    for r, v in zip(rows, values, strict=True):
                        r.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                cols = [part.column(0), part.column(1), *[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "n_a", "n_b", "both", "rest"])

    one = sets.select(F.col("key").alias("a"), F.col("found").alias("f_a"))
    two = sets.select(F.col("key").alias("b"), F.col("found").alias("f_b"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "f_a", "f_b").filter("length(f_a) > 0 and length(f_b) > 0")
    return joined.mapInArrow(run, "a long, b long, n_a long, n_b long, both long, rest array<long>")


def _linked(percent: int):
    return F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent


def _around(rows: DataFrame, table: DataFrame, salts: int = 16) -> DataFrame:
    """Adds to ``rows`` what ``table`` has on their pivot ``a``; a pivot with most of the rows is dealt to several tasks."""
    table = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int")).join(table, ["a", "salt"], "left").drop("salt")


def _next_buckets(spokes: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """``bucket, doc_id, n, lead, own, kind``: every pair of spokes of one pivot that may be a link between two components
    shares a bucket, in which one that leads meets one that is there on its own; with ``n`` given, the smaller one leads."""
    t = percent / 100
    union = F.col("n_a") + F.col("n_b") - F.col("both")
    kind = F.when(_linked(percent), "L").when(F.col("both") >= union * (2 * t - 1), "M").otherwise("F").alias("kind")
    own = spokes.join(joined.select(F.col("u").alias("b"), F.col("v").alias("component")), "b", "left")
    own = written(own.select("a", "b", F.coalesce("component", "b").alias("part"), F.col("n_b").alias("n"), F.col("both").alias("o"), "rest", kind), "spokes")
    near, far = F.col("kind") == "L", F.col("kind") == "F"
    low, size_class = F.ceil(F.col("n") * t - 1e-9), lambda n: F.floor(F.log(n) / math.log(SIZE_STEP)).cast("int")
    top = F.least(F.floor(F.col("o") * (1 + t) / t + 1e-9) - F.col("n"), F.floor(F.col("n") / t + 1e-9))
    around = own.groupBy("a").agg(
        F.count(F.lit(1)).alias("width"),
        F.min("n").alias("least"),
        F.max(~near & (low <= top)).alias("open"),
        F.max(F.when(near, F.col("part"))).alias("home"),
        *[f(F.when(c, F.col("part"))).alias(k) for c, of in ((~near, "n"), (~near & ~far, "m")) for k, f in ((f"lo_{of}", F.min), (f"hi_{of}", F.max))],
    )
    around = written(around, "around")
    # members without a partner of a fit kind in another component are out; by the triangle inequality a member far from the
    # pivot has no link with one that the pivot has
    other = lambda of: (F.col(f"lo_{of}") != F.col("part")) | (F.col(f"hi_{of}") != F.col("part"))
    partnered = F.when(near, other("m")).when(far, other("n")).otherwise(F.coalesce(F.col("home") != F.col("part"), F.lit(False)) | other("n"))
    placed = _around(own, around).filter(partnered)
    # by size: the partner's size lies between t n and what the own overlap with the pivot allows; most members allow none.
    # Of a pair one at least is no link of the pivot; it leads in the classes of its partner's size,
    # where the partner is on its own
    fit = placed.filter(F.col("open") & (low <= top))
    mine = F.when(~near, F.transform(F.sequence(size_class(F.greatest(low, F.lit(1))), size_class(top)), lambda g: F.struct(F.lit(True).alias("lead"), g.alias("g"))))
    classes = F.concat(F.coalesce(mine, F.array().cast("array<struct<lead:boolean,g:int>>")), F.array(F.struct(F.lit(False).alias("lead"), size_class(F.col("n")).alias("g"))))
    sized = fit.select("a", "b", "kind", F.explode(classes).alias("s"))
    sized = sized.select(F.xxhash64("a", F.lit("size"), "s.g").alias("bucket"), F.col("b").alias("doc_id"), F.lit(0).cast("long").alias("n"), "s.lead", (~F.col("s.lead")).alias("own"), "kind")
    # by rest: shingles that a sample of the members shows to be common come last, in one order for all members of a pivot
    drawn = _around(own, around.select("a", "width")).filter(F.pmod(F.xxhash64("b"), F.col("width")) < RARITY_SAMPLE)
    common = drawn.select("a", F.explode("rest").alias("g")).groupBy("a", "g").agg(F.count(F.lit(1)).alias("times")).filter("times > 2")
    common = common.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("times", "g"))).alias("c")).select("a", F.col("c.g").alias("common"))
    ordered = _around(placed, common)
    rest = F.when(F.col("common").isNull(), F.col("rest")).otherwise(F.concat(F.array_except("rest", "common"), F.array_intersect("common", "rest")))
    need = lambda least: F.greatest(F.lit(1), F.ceil((F.col("n") + least) * (t / (1 + t)) - 1e-9) - F.col("o"))
    reach = lambda least: F.greatest(F.lit(0), F.size("rest") - need(least) + 1).cast("int")
    first = F.slice(rest, F.lit(1), reach(F.greatest(low, F.col("least"))))
    shared = ordered.select("a", "b", "kind", "n", reach(F.col("n")).alias("short"), F.posexplode(first).alias("at", "g"))
    shared = shared.select(F.xxhash64("a", "g").alias("bucket"), F.col("b").alias("doc_id"), "n", (F.col("at") < F.col("short")).alias("lead"), F.lit(True).alias("own"), "kind")
    return sized.unionByName(shared)


def _pivots(large: DataFrame, lend: bool) -> DataFrame:
    """``a, b``: each member of the large buckets with its bucket's pivot; with ``lend``, it may be that of other buckets."""
    central = large.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    ranked = large.select("bucket", "doc_id").join(central, "doc_id").groupBy("bucket").agg(F.max(F.struct("times", F.xxhash64("doc_id").alias("draw"), "doc_id")).alias("m"))
    own = written(large.join(ranked.select("bucket", F.col("m.doc_id").alias("pivot")), "bucket").select("bucket", "doc_id", "pivot"), "pivots")
    if not lend:
        spokes = written(own.filter("doc_id != pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), "spokes")
        drop_written(own)
        return spokes
    # a bucket whose members are all with one larger pivot is left to that one, so that few members have several pivots
    held = own.select("doc_id", "pivot").distinct()
    widest = held.join(held.groupBy("pivot").agg(F.count(F.lit(1)).alias("width")), "pivot").groupBy("doc_id").agg(F.max(F.struct("width", "pivot")).alias("w"))
    agreed = own.join(widest.select("doc_id", F.col("w.pivot").alias("wide")), "doc_id").groupBy("bucket").agg(F.min("wide").alias("lo"), F.max("wide").alias("hi"))
    spokes = own.join(agreed, "bucket").withColumn("pivot", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("pivot")))
    spokes = spokes.filter("doc_id != pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    spokes = written(spokes, "spokes")
    drop_written(own)
    return spokes


def _linked_parts(docs: DataFrame, heads: DataFrame, placed: DataFrame, width: int, percent: int) -> DataFrame:
    """``u, v``: the documents that hang on a lesser one of their component, and the least of it; ``placed`` has ``bucket, doc_id`` of the bands."""
    most_meetings = FEW * heads.count()
    members = placed.select("bucket", "doc_id", F.lit(0).cast("long").alias("n"), F.lit(True).alias("lead"), F.lit(True).alias("own"), F.lit("M").alias("kind"))
    joined = sets = None
    for level in range(LEVELS):
        if joined is None:  # every document is a part of its own
            parted = members.withColumn("part", F.col("doc_id"))
            useful = parted.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.max("part").alias("main")).filter("m > 1").select("bucket", (F.col("m") - 1).alias("others"), "main")
        else:
            # most shingles are of one document: their buckets go before anything is joined
            met = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.max("lead").alias("led"), F.max("own").alias("met")).filter("m > 1 and led and met")
            parted = members.join(met.select("bucket"), "bucket", "left_semi").join(joined.select(F.col("u").alias("doc_id"), F.col("v").alias("component")), "doc_id", "left")
            parted = written(parted.withColumn("part", F.coalesce("component", "doc_id")).drop("component"), "parted")
            # the largest part of a bucket need not be compared within itself: the others meet all
            by_part = parted.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("m"))
            useful = by_part.groupBy("bucket").agg(F.sum("m").alias("m"), F.max(F.struct("m", "part")).alias("top"))
            useful = useful.filter("m > top.m").select("bucket", (F.col("m") - F.col("top.m")).alias("others"), F.col("top.part").alias("main"))
        mates = written(parted.join(useful, "bucket"), "mates")
        drop_written(members)
        drop_written(parted)
        # what a comparison of all that is left would meet; few enough, no further round is worth its while
        meetings = mates.agg(F.sum(F.col("others").cast("double"))).first()[0]
        if level and meetings is None:
            drop_written(mates)
            break
        last = level == LEVELS - 1 or level > 0 and meetings <= most_meetings
        most = LATER_SMALL if level else SMALL
        small, large = (mates, mates.limit(0)) if last else (mates.filter(F.col("others") <= most), mates.filter(F.col("others") > most))
        left, right = (df.select("bucket", "main", *[F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "n", "lead", "own", "kind", "part")]) for df, k in ((small.filter("part != main"), "x"), (small, "y")))
        meet = "part_x != part_y and (part_y = main or doc_id_x < doc_id_y) and (lead_x and own_y and n_x <= n_y or lead_y and own_x and n_y <= n_x) and concat(kind_x, kind_y) not in ('LF', 'FL')"
        close = left.join(right.drop("main"), "bucket").filter(meet).select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()
        close = written(_likely(close, heads, percent / 100 - SLACK), "likely")
        spokes = None if large.isEmpty() else _pivots(large, level == 0)
        if sets is None:  # the pairs of later levels are of these documents too
            asked = close.select("a", "b") if spokes is None else close.select("a", "b").union(spokes)
            sets = written(_sets(docs, asked, width), "sets")
        links, measured = _measured(close, sets, False).filter(_linked(percent)).select("a", "b"), None
        if spokes is not None:
            measured = written(_measured(spokes, sets, True), "measured")
            links = links.union(measured.filter(_linked(percent)).select("a", "b"))
        links = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        links, before = written(links, "links"), None
        if joined is None or not links.isEmpty():
            before, joined = joined, stars(links if joined is None else links.union(joined))
        for done in (mates, close, spokes, links, before):
            drop_written(done)
        if measured is None:
            break
        members = written(_next_buckets(measured, joined, percent), "members")
        drop_written(measured)
    drop_written(sets)
    return joined


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the least identifier reachable over links; ``kept`` marks that document. A text without words,
    or null, has the empty set and is linked with nothing. Rows that share an identifier are one node: their sets are
    confirmed by any of them. A null identifier is a row of its own: its component is null and it is kept. Other columns are not
    read. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("body"))
    signed = written(signatures(docs, width, "key", "body"), "signatures")
    live = signed.filter("doc_id is not null and n_shingles > 0")
    classes = written(live.groupBy("same").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("members")), "classes")
    heads = live.join(classes.select(F.col("same").alias("own"), "head"), (F.col("doc_id") == F.col("head")) & (F.col("same") == F.col("own")), "left_semi")
    heads = written(heads.select("doc_id", "bands", "minima"), "heads")
    slim = written(signed.select("doc_id", "n_shingles", "same"), "sets_of")
    drop_written(signed)
    signed = slim
    joined = _linked_parts(docs, heads, heads.select("doc_id", F.explode("bands").alias("bucket")), width, percent)
    heads_of = heads.select(F.col("doc_id").alias("head")).distinct()
    final = heads_of.join(joined, heads_of["head"] == joined["u"], "left").select("head", F.coalesce("v", "head").alias("component_id"))
    by_class = written(classes.join(final, "head").select("same", "head", "component_id"), "final")
    # rows with one identifier and different texts are one node: what shares it is joined once more
    repeated = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = signed.select("doc_id", "n_shingles", "same").join(by_class.select("same", "component_id"), "same", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))))
    if not repeated.isEmpty():
        ties = out.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
        tied = components(written(ties.distinct(), "ties")).withColumnsRenamed({"node": "from", "component": "into"})
        out = out.join(tied, out["component_id"] == tied["from"], "left").withColumn("component_id", F.coalesce("into", "component_id")).drop("from", "into")
    for done in (classes, heads, joined):
        drop_written(done)
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_firsts(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the least identifier of each component, all columns kept."""
    found = near_duplicates(docs, width, percent, id_col, text_col)
    gone = found.filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["gone_id"], "left_anti")


def keep_single(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each component, all columns kept: that of the least identifier, null ones last.

    Rows are linked and kept by a key of their own, given in a table in the shared folder, so copies go whether they share
    an identifier, have none, or are rows that are equal throughout. Rows that share an identifier and are no near copies
    are different documents and stay, as do all texts without words.
    """
    key = "row_key"
    while key.lower() in {c.lower() for c in docs.columns}:
        key += "_"
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, width, percent, key, text_col).select(F.col("doc_id").alias("own"), "component_id")
    ids = rows.select(F.col(key).alias("own"), F.col(id_col).cast("long").alias("id"))
    placed = written(found.join(ids, "own"), "placed")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "own")).alias("m"))
    gone = placed.select("own").join(first.select(F.col("m.own").alias("own")), "own", "left_anti")
    # dealt by key at any size: who goes grows with the rows
    return rows.join(gone.hint("merge"), rows[key] == gone["own"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
with recursive worded as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) end as s from worded),
class as (select min(doc_id) as head, s, len(s) as n from sets group by s),
items as (select head, n, unnest(s) as g from class where n > 0),
common as (
  select a.head as u, b.head as v, any_value(a.n) as nu, any_value(b.n) as nv, count(*) as shared
  from items a join items b on a.g = b.g and a.head < b.head and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.head, b.head),
links as (select u, v from common where 100 * shared >= 80 * (nu + nv - shared)),
ways as (select u, v from links union all select v, u from links),
reach as (select u as node, u as seen from (select u from ways) union select reach.node, ways.v from reach join ways on reach.seen = ways.u),
least as (select node, min(seen) as component from reach group by node)
select d.doc_id, len(d.s)::bigint as n_shingles, case when len(d.s) = 0 then d.doc_id else coalesce(l.component, c.head) end as component_id,
  d.doc_id = case when len(d.s) = 0 then d.doc_id else coalesce(l.component, c.head) end as kept
from sets d join class c on d.s = c.s left join least l on l.node = c.head
"""
