"""Substring dedup: words of long passages that an earlier document has too go, found by super-k-mers.

A window is ``width`` consecutive words. Its minimiser is the least hash of the runs of ``RUN`` words in it; consecutive
windows with one minimiser are a super-k-mer, one string of words, whose bucket is the minimiser. Equal windows have equal
minimisers, so they meet in one bucket.

1. Every super-k-mer is told by its bucket, its document and two 64-bit hashes of its words. A bucket with one document has
   nothing to remove. In a bucket whose super-k-mers are all equal by both hashes (copies), each document after the first loses
   all windows of it. What is left are mixed buckets; only their super-k-mers travel as packed strings.
2. Texts meet their super-k-mers by document. Rows without mixed ones are finished there, the others hand on their packed
   strings. In a mixed bucket equal strings are one, with the least document that has it, so that copies of a passage make
   one row. The windows of each string are sorted and counted by 128-bit digests of their words: a window is removed where a
   string of an earlier document has it. A hot bucket is spread, as strings and windows are dealt out by their own content.
3. Rows with mixed super-k-mers are finished with what the buckets say.

Wrong equality needs a collision of 128 bits. Very long texts are taken in stretches that overlap by a window, and a
super-k-mer of very repetitive text is cut after ``LONGEST`` windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Words of a window, words of the runs whose hashes are compared, windows of a super-k-mer at most, words of a stretch.
WIDTH, RUN, LONGEST, STRETCH = 50, 16, 128, 200_000


@lru_cache
def _numbers() -> tuple[np.ndarray, np.ndarray, int]:
    """Fixed random numbers: two tables of byte values and the odd base of powers."""
    rng = np.random.default_rng(50)
    draw = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    return draw(256), draw(256), int(draw(1)[0]) | 5


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        base, size = _numbers()[2], 1 << (n - 1).bit_length()
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    have, done = values, 1
    while done * 2 <= width:
        have, done = np.minimum(have[:-done], have[done:]), done * 2
    return np.minimum(have[: len(have) - (width - done)], have[width - done :]) if width > done else have


def super_kmers(found: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """``key, start, n, one, two`` of the super-k-mers of a sequence of words: minimiser, first window, windows, hashes."""
    run, parts = min(RUN, width), []
    for lo in range(0, max(0, len(found) - width + 1), STRETCH):
        some = found[lo : lo + STRETCH + width - 1]
        lengths = np.fromiter(map(len, some), np.int64, len(some))
        ends = np.cumsum(lengths + 1) - 1
        begins = ends - lengths
        raw = np.frombuffer(b" ".join(some), np.uint8)
        power, inverse = _power(len(raw) + 1)
        sums = []
        for values in _numbers()[:2]:
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(values[raw] * power[: len(raw)], out=total[1:])
            sums.append(total)
        of = lambda total, b, e: _mix((total[e] - total[b]) * inverse[b] + (e - b).astype(np.uint64))  # noqa: E731, B023
        runs = of(sums[0], begins[: len(some) - run + 1], ends[run - 1 :])
        least = _least(runs, width - run + 1)
        start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        size = np.diff(np.append(start, len(least)))
        if size.max() > LONGEST:
            pieces = -(-size // LONGEST)
            first = np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.repeat(start, pieces) + (np.arange(len(first)) - first) * LONGEST
            size = np.diff(np.append(start, len(least)))
        b, e = begins[start], ends[start + size + width - 2]
        parts.append((least[start].view(np.int64), start + lo, size, of(sums[0], b, e).view(np.int64), of(sums[1], b, e).view(np.int64)))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _keys(rows: DataFrame, width: int) -> DataFrame:
    """``key, doc, row, start, n, one, two``: a row for each super-k-mer of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                made = [super_kmers(body.split(), width) for body in part.column(2).to_pylist()]
                sizes = [len(m[0]) for m in made]
                key, start, n, one, two = (np.concatenate([m[k] for m in made]) for k in range(5))
                doc, row = (np.repeat(part.column(k).to_numpy(zero_copy_only=False), sizes) for k in (0, 1))
                columns = [key, doc, row, start.astype(np.int32), n.astype(np.int32), one, two]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "doc", "row", "start", "n", "one", "two"])

    return rows.filter("doc is not null").select("doc", "row", "body").mapInArrow(run, "key long, doc long, row long, start int, n int, one long, two long")


def _finished(found: list[bytes], windows: list[tuple[int, int]], width: int) -> tuple[int, int, str]:
    """``n_words, n_removed, kept_sha256`` when the windows ``(first, number)`` go."""
    edges = np.zeros(len(found) + 1, np.int64)
    for start, n in windows:
        edges[start] += 1
        edges[start + n + width - 1] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    kept = [w for w, g in zip(found, gone.tolist(), strict=True) if not g] if windows else found
    return len(found), int(gone.sum()), sha256(b" ".join(kept)).hexdigest()


_STATE = "doc long, n_words long, n_removed long, sha string, row long, body binary, settled array<int>, key long, start int, n int, packed binary, digest binary"
_STATE_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _settle(met: DataFrame, width: int) -> DataFrame:
    """Of rows ``doc, row, body, spans``: finished ones (with ``sha``), open ones (with ``body``), packed strings (with ``packed``)."""
    names = [c.split(" ")[0] for c in _STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, out = batch.slice(lo, 500), []
                for doc, row, body, spans in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    found = body.split()
                    sure = [(s["start"], s["n"]) for s in spans or () if not s["mixed"]]
                    open_ones = [s for s in spans or () if s["mixed"]]
                    if not open_ones:
                        out.append((doc, *_finished(found, sure, width), *[None] * 8))
                        continue
                    out.append((doc, None, None, None, row, body, [x for pair in sure for x in pair], *[None] * 5))
                    for s in open_ones:
                        packed = b" ".join(found[s["start"] : s["start"] + s["n"] + width - 1])
                        out.append((doc, None, None, None, row, None, None, s["key"], s["start"], s["n"], packed, blake2b(packed, digest_size=16).digest()))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(_STATE_KINDS)], names=names)

    return met.select("doc", "row", "body", "spans").mapInArrow(run, _STATE)


def _windows(strings: DataFrame, width: int) -> DataFrame:
    """``string, lo, at, one, two``: the windows of each packed string, by a digest of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for from_row in range(0, batch.num_rows, 500):
                part = batch.slice(from_row, 500)
                ids, digests, at = [], [], []
                for k, packed in enumerate(part.column(2).to_pylist()):
                    found = packed.split(b" ")
                    ends = np.cumsum([len(w) + 1 for w in found]) - 1
                    begins = [0, *(ends[:-1] + 1).tolist()]
                    for j in range(len(found) - width + 1):
                        digests.append(blake2b(packed[begins[j] : ends[j + width - 1]], digest_size=16).digest())
                    ids.extend([k] * (len(found) - width + 1))
                    at.extend(range(len(found) - width + 1))
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                columns = [*[part.column(c).take(pa.array(ids, pa.int64())) for c in (0, 1)], pa.array(at, pa.int32()), *[pa.array(halves[:, c].copy()) for c in (0, 1)]]
                yield pa.RecordBatch.from_arrays(columns, names=["string", "lo", "at", "one", "two"])

    return strings.select("string", "lo", "packed").mapInArrow(run, "string long, lo long, at int, one long, two long")


def _in_buckets(pieces: DataFrame, width: int) -> DataFrame:
    """``doc, row, windows``: what the mixed buckets say of each row, pairs of first window and number."""
    # equal strings of a bucket are one, with the first document that has it
    strings = pieces.groupBy("key", "digest").agg(F.min("doc").alias("lo"), F.first("packed").alias("packed"))
    strings = written(strings.withColumn("string", F.monotonically_increasing_id()), "strings")
    windows = written(_windows(strings, width), "windows")
    firsts = windows.groupBy("one", "two").agg(F.min("lo").alias("first"), F.max("lo").alias("last")).filter("first < last")
    late = windows.join(firsts, ["one", "two"]).filter("first < lo").groupBy("string").agg(F.collect_set("at").alias("late"))
    late = written(late, "late")
    drop_written(windows)
    known = strings.select("key", "digest", "lo", "string").join(late, "string", "left")
    told = pieces.select("key", "digest", "doc", "row", "start", "n").join(known, ["key", "digest"])
    one_each = F.transform("late", lambda j: F.struct((F.col("start") + j).alias("start"), F.lit(1).alias("n")))
    gone = F.when(F.col("doc") > F.col("lo"), F.array(F.struct("start", "n"))).otherwise(one_each)
    return told.select("doc", "row", F.explode(gone).alias("w")).groupBy("doc", "row").agg(F.collect_list("w").alias("windows"))


def _finish(open_rows: DataFrame, width: int) -> DataFrame:
    """Rows ``doc, body, settled, windows`` finished."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, out = batch.slice(lo, 500), []
                for doc, body, settled, windows in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    gone = list(zip(settled[::2], settled[1::2], strict=True)) + [(w["start"], w["n"]) for w in windows or ()]
                    out.append((doc, *_finished(body.split(), gone, width)))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(_STATE_KINDS[:4])], names=["doc", "n_words", "n_removed", "sha"])

    return open_rows.select("doc", "body", "settled", "windows").mapInArrow(run, "doc long, n_words long, n_removed long, sha string")


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row of ``docs``.

    A word is removed if it lies in a window of ``width`` words that also starts in a row with a smaller identifier; windows
    are those of the input. Texts shorter than a window lose nothing; null and empty texts have no words. Rows that share an
    identifier do not count as earlier than each other. A row without an identifier is compared with nothing. Other
    columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")).select("doc", F.xxhash64("body").alias("row"), "body")
    keys = written(_keys(rows, width), "super_kmers")
    hashes = [f(c).alias(f"{f.__name__}_{c}") for c in ("one", "two") for f in (F.min, F.max)]
    shared = keys.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), *hashes).filter("lo < hi")
    shared = written(shared.select("key", "lo", F.expr("min_one != max_one or min_two != max_two").alias("mixed")), "shared")
    spans = keys.select("key", "doc", "row", "start", "n").join(shared, "key").filter("mixed or doc > lo")
    by_row = spans.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "n", "key", "mixed")).alias("spans"))
    none = F.lit(None).cast("array<struct<start:int,n:int,key:bigint,mixed:boolean>>").alias("spans")
    met = rows.filter("doc is not null").join(by_row, ["doc", "row"], "left").unionByName(rows.filter("doc is null").select("*", none))
    state = written(_settle(met, width), "state")
    drop_written(keys)
    pieces = state.filter("packed is not null").select("key", "doc", "row", "start", "n", "packed", "digest")
    open_rows = state.filter("body is not null").select("doc", "row", "body", "settled")
    finished = state.filter("sha is not null").select("doc", "n_words", "n_removed", "sha")
    late = _finish(open_rows.join(_in_buckets(pieces, width), ["doc", "row"], "left"), width)
    return finished.unionByName(late).select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.col("sha").alias("kept_sha256"))


ORACLE = r"""
with worded as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as g from worded, unnest(range(1, len(w) - 48)) as u(i)),
firsts as (select g, min(doc_id) as first from windows group by g),
late as (select doc_id, i from windows join firsts using (g) where first < doc_id),
gone as (select distinct doc_id, j from late, unnest(range(i, i + 50)) as u(j)),
words as (select doc_id, j, w[j] as word from worded, unnest(range(1, len(w) + 1)) as u(j)),
kept as (select doc_id, string_agg(word, ' ' order by j) as kept, count(*) as n from words anti join gone using (doc_id, j) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from worded left join kept using (doc_id)
"""
