"""Spelling variant grouping: words one edit apart, by bands of letter-parity masks.

A word's mask has a bit for each letter, set if the letter stands in it an odd number of times; one edit flips at most two
bits. Two words one replacement apart have equally many letters, so each mask is taken by place: its three bands are the
masks of the letters at every third place. The two flipped bits lie in one band and the other two bands are equal. Two
words one insertion apart differ in one bit, which lies in one of three bands of letters, so again two bands are equal.
There the half of the word without the edit is whole, so its mask is equal too, and goes into the key. Words meet in joins on
equal bands and lengths, and pairs are verified by edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from operator import xor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Least code points and occurrences of a word, share of runs that lose a letter, how much more frequent a form is.
MIN_LENGTH, MIN_COUNT, DELETE_EVERY, FORM_RATIO = 7, 2, 31, 10
#: Words that a task holds before it hands its counts on.
HELD = 300_000
#: A form is FORM_RATIO times as frequent as its word, so chains of forms are at most nineteen long.
MOST_ROUNDS = 8

#: In Latin-1: letters A-Z (as a-z), a-z and U+00C0 to U+00FF stay, all else is a space. What is beyond Latin-1 becomes '?' first.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
#: The bit of each letter: 26 for a-z, the others share 38.
BIT = [1 << (c - 97 if 97 <= c <= 122 else 26 + (c - 192) % 38) if 97 <= c <= 122 or c >= 192 else 0 for c in range(256)]
#: Three bands of letters.
BANDS = [sum(1 << b for b in range(64) if b % 3 == k) for k in range(3)]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: words of whole texts with at least ``min_length`` code points and ``min_count`` occurrences.

    Of every run of letters whose checksum with the document's identifier says so, one letter is deleted first. Null texts
    have no words; a null identifier is read as ''.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{key}:".encode())
                latin = body.decode("utf-8", "replace").encode("latin-1", "replace").translate(FOLD)
                for word, n in Counter(w for w in latin.split() if len(w) >= min_length).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % DELETE_EVERY == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def masks(words: DataFrame) -> DataFrame:
    """Adds to ``word, n`` the length and the parity masks of parts of the word.

    ``t_0, t_1, t_2``: letters at every third place. ``a_*, b_*``: what stands before and after the middle, for the word as the
    longer one (``x``), and as the shorter one of a pair whose edit lies before (``y``) or after (``z``) the longer one's middle.
    """
    names = ["t_0", "t_1", "t_2", "a_x", "b_x", "a_y", "b_y", "a_z", "b_z"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                bits = [BIT[c] for c in word.encode("latin-1")]
                upto, size = [0, *accumulate(bits, xor)], len(bits)
                middle, above = size // 2, (size + 1) // 2
                cuts = [(upto[at], upto[size] ^ upto[at]) for at in (middle, above - 1, above)]
                rows.append([size, *[reduce(xor, bits[k::3], 0) for k in range(3)], *[m for cut in cuts for m in cut]])
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
            sizes, parts = pa.array(columns[0], pa.int32()), [pa.array(c, pa.uint64()).view(pa.int64()) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, *parts], names=["word", "n", "size", *names])

    return words.select("word", "n").mapInArrow(run, "word string, n long, size int, " + ", ".join(f"{c} long" for c in names))


def _without(mask: str, band: int) -> Column:
    signed = BANDS[band] - (1 << 64) if BANDS[band] >> 63 else BANDS[band]
    return F.col(mask).bitwiseAND(F.lit(~signed))


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: all pairs of different words of ``word, n`` that one edit turns into each other, each once."""
    masked = written(masks(words), "masks")
    size = F.col("size")
    replaced = [F.xxhash64(F.lit(k), size, F.col(f"t_{(k + 1) % 3}"), F.col(f"t_{(k + 2) % 3}")) for k in range(3)]
    keyed = masked.select("word", "n", F.explode(F.array(*replaced)).alias("key"))
    left, right = (keyed.select("key", F.col("word").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    one_edit = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    same = left.join(right, "key").filter((F.col("a") < F.col("b")) & one_edit)
    # the longer word with what the shorter one would be as a part of it: edit before the middle, edit after it
    keys = lambda n, before, after: F.array(*[F.xxhash64(F.lit(3 + k), n, F.col(before[1]), _without(before[0], k)) for k in range(3)], *[F.xxhash64(F.lit(6 + k), n, F.col(after[0]), _without(after[1], k)) for k in range(3)])
    longer = masked.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(keys(size, ("a_x", "b_x"), ("a_x", "b_x"))).alias("key"))
    shorter = masked.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(keys(size + 1, ("a_y", "b_y"), ("a_z", "b_z"))).alias("key"))
    apart = longer.join(shorter, "key").filter((F.length("a") == F.length("b") + 1) & one_edit)
    return same.unionByName(apart).select("a", "n_a", "b", "n_b").distinct()  # a pair may meet by more than one key


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: each form followed to the last by doubling the way in every round."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MOST_ROUNDS):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        last, now = now, written(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_written(last)
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
    raise RuntimeError(f"roots did not settle in {MOST_ROUNDS} rounds")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, form_ratio: int = FORM_RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of :func:`word_counts`.

    ``n_near`` counts the words one edit apart; the most frequent of these (the first in code-point order among equals) is
    the ``form`` if it is at least ``form_ratio`` times as frequent; ``root`` is the last of the forms. Repeated rows count
    as often as they are there. Other columns are not read. An empty table gives no rows.
    """
    words = written(word_counts(docs, id_col, text_col, min_length, min_count), "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word")))
    found = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best.alias("m"))
    placed = words.join(found, words["word"] == found["a"], "left")
    formed = (-F.col("m.less")) >= F.col("n") * form_ratio
    placed = placed.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("m.word")).alias("form"), F.when(formed, -F.col("m.less")).alias("form_n"))
    placed = written(placed, "forms")
    drop_written(pairs)
    roots = _roots(placed.filter("form is not null"))
    return placed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: The checksum is made by rule: a table of 256 entries of eight shifts each, then one step for each byte.
ORACLE = r"""
with recursive crc as (
  select list_transform(range(256), lambda c: list_reduce([c::ubigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)) as t),
runs as (
  select coalesce(doc_id::varchar, '') as key, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents),
counted as (select key, run, count(*) as n from runs where length(run) >= 7 group by key, run),
hexed as (select *, hex(encode(key || ':' || run)) as h from counted),
summed as (
  select key, run, n, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::ubigint)),
    lambda x, y: xor(t[(xor(x, y) & 255)::int + 1], x >> 8)), 4294967295::ubigint) as c from hexed, crc),
changed as (
  select n, case when c % 31 = 0 then substr(run, 1, (c % length(run)::ubigint)::int) || substr(run, (c % length(run)::ubigint)::int + 2) else run end as word from summed),
words as (select word, sum(n)::bigint as n from changed where length(word) >= 7 group by word having sum(n) >= 2),
cut as (select word, n, length(word) as size, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from words, unnest(range(1, length(word) + 1)) as u(i)),
near as (
  select a.word as a, b.word as b, b.n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.size = b.size and a.word != b.word
  union select c.word, w.word, w.n from cut c join words w on c.rest = w.word
  union select w.word, c.word, c.n from cut c join words w on c.rest = w.word),
best as (select a, count(*) as n_near, arg_min(b, (-n, b)) as form, max(n) as form_n from near group by a),
placed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 10 * w.n then form end as form, case when form_n >= 10 * w.n then form_n end as form_n from words w left join best on a = w.word),
ways as (select word, word as at, form as next from placed union all select w.word, p.word, p.form from ways w join placed p on p.word = w.next)
select p.word, p.n, p.n_near, p.form, p.form_n, w.at as root from placed p join ways w on w.word = p.word and w.next is null
"""
