"""Document fingerprints by consistent weighted sampling.

A document is its words with their counts. For each sample, every weighted term gets the gamma-based value of Ioffe
(2010), whose seeds come from a hash of term and sample alone; the smallest value is the document's sample. Two
documents share a sample with the chance of their generalised Jaccard similarity, so the share of equal samples
estimates it. The value itself identifies the winning (term, level), hence a sample is one ``min`` of a double: all
samples are one hash aggregate of fixed width with partial sums, in generated code. Three logarithms a sample and term are
the cost, so terms that a product of uniforms shows to be no winner are passed by first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words, written

#: Samples of a fingerprint; the likeness has a standard error of at most 1 / (2 sqrt(SAMPLES)).
SAMPLES = 64
#: An odd number whose odd multiples tell the samples' hashes of one term apart.
_STEP = 0x1E3779B97F4A7C15
#: A sample's smallest value is exponential with the document's number of words as its rate, so it exceeds BOUND / words
#: with a chance of e^-30 (10^-13). Terms whose value is shown to exceed that by a cheap bound cannot win a sample.
BOUND = 30.0


def _double(bits: Column) -> Column:
    return bits.cast("double")


def _quarters(h: Column) -> list[Column]:
    """The four 16-bit parts of a hash."""
    return [F.shiftrightunsigned(h, 48), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(h, 16).bitwiseAND(F.lit(0xFFFF)), h.bitwiseAND(F.lit(0xFFFF))]


def _value(h: Column, log_weight: Column) -> Column:
    """The logarithm of a term's sampling value: ln c - ln y - r with r, c ~ Gamma(2, 1) and b uniform.

    Each of four uniforms has 16 bits of ``h``, which is the hash of term and sample, and 16 bits of a hash of that.
    """
    more = F.xxhash64(h)
    u = [(_double(x) + _double(y) * 2.0**-16 + 2.0**-17) * 2.0**-16 for x, y in zip(_quarters(h), _quarters(more), strict=True)]
    r = -F.ln(u[0] * u[1])
    log_c = F.ln(-F.ln(u[2] * u[3]))
    beta = (_double(F.shiftrightunsigned(F.xxhash64(more), 11)) + 0.5) * (2.0**-53)
    level = _double((log_weight / r + beta).cast("long"))  # never negative, so the cast is the floor
    return log_c - r * (level - beta) - r


def _may_win(h: Column, cut: Column) -> Column:
    """Whether a term's value can be at most ``cut`` / 2^64.

    With level <= ln(w) / r + b the value is at least c e^-r / w, where e^-r = u0 u1 and c >= 1 - u2 u3. The first 16 bits
    of each uniform bound it from below, so no logarithm is taken. ``cut`` holds the weight.
    """
    t = _quarters(h)
    return _double(t[0]) * _double(t[1]) * (2.0**32 - (_double(t[2]) + 1.0) * (_double(t[3]) + 1.0)) <= cut


def samples(texts: DataFrame, keys: list[str], text_col: str, n: int = SAMPLES) -> DataFrame:
    """``keys`` and ``samples`` (array of ``n`` integers) for every row with a word in its text; ``keys`` must be unique."""
    # words are counted within their row: hashes in order, the places at which a new one begins, and the next such place
    counted = texts.select(*keys, F.sort_array(F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w))).alias("cws_terms"))
    begins = F.transform("cws_terms", lambda x, i: F.when((i == 0) | (F.get("cws_terms", i - 1) != x), i))
    counted = counted.select("*", F.size("cws_terms").alias("cws_n"), F.filter(begins, lambda i: i.isNotNull()).alias("cws_begin"))
    ends = F.concat(F.slice("cws_begin", F.lit(2), F.greatest(F.size("cws_begin") - 1, F.lit(0))), F.array("cws_n"))
    counted = counted.filter("cws_n > 0").withColumn("cws_end", ends)
    # the outer form, for which Spark adds no filters that make the arrays again; they are not empty
    terms = counted.select(*keys, "cws_terms", "cws_n", F.explode_outer(F.arrays_zip("cws_begin", "cws_end")).alias("cws_at"))
    count = F.col("cws_at.cws_end") - F.col("cws_at.cws_begin")
    weighted = terms.select(*keys, "cws_n", F.get("cws_terms", F.col("cws_at.cws_begin")).alias("cws_term"), count.alias("cws_count"))
    hashes = [F.xxhash64(F.col("cws_term").bitwiseXOR(F.lit(_STEP * (2 * k + 1) % (1 << 62)))).alias(f"cws_h{k}") for k in range(n)]
    drawn = weighted.select(*keys, F.ln("cws_count").alias("cws_weight"), (F.col("cws_count") * (BOUND * 2.0**64) / F.col("cws_n")).alias("cws_cut"), *hashes)
    least = drawn.groupBy(*keys).agg(*[F.min(F.when(_may_win(F.col(f"cws_h{k}"), F.col("cws_cut")), _value(F.col(f"cws_h{k}"), F.col("cws_weight")))).alias(f"cws_{k}") for k in range(n)])
    return least.select(*keys, F.array(*[F.hash(f"cws_{k}") for k in range(n)]).alias("samples"))


def as_text(found: Column) -> Column:
    """Eight hexadecimal digits a sample; '' for a text without words."""
    digits = F.transform(found, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.coalesce(F.concat_ws("", digits), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two texts without words are alike, one is unlike any other."""
    equal = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"] == z["b"])) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal.cast("double"))


def in_order(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``next_id, next_hash``: the row after each in descending (id, hash), the first after the last.

    Rows are dealt by range; what crosses a border comes from a table with one row per range.
    """
    by = [F.col("fp_id").desc_nulls_last(), F.col("fp_hash").desc()]
    dealt = rows.repartitionByRange(n, *by).withColumn("fp_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    inside = Window.partitionBy("fp_range").orderBy(*by)
    here = F.struct(F.col("fp_id").alias("id"), F.col("fp_hash").alias("hash"))
    led = dealt.withColumns({"fp_next": F.lead(here).over(inside), "fp_at": F.row_number().over(inside)})
    led = led.withColumn("fp_this", here)
    heads = led.filter("fp_at = 1").select("fp_range", F.col("fp_this").alias("fp_head"))
    ranges = Window.orderBy("fp_range")  # as many rows as ranges
    around = F.coalesce(F.lead("fp_head").over(ranges), F.first("fp_head").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    borders = heads.select("fp_range", around.alias("fp_border"))
    out = led.join(borders, "fp_range").withColumn("fp_next", F.coalesce("fp_next", "fp_border"))
    return out.select(*rows.columns, F.col("fp_next.id").alias("next_id"), F.col("fp_next.hash").alias("next_hash"))


def fingerprints(docs: DataFrame, n: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, in which the last half is the next document's beginning.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. A null text is
    empty; a text without words has the fingerprint ''. The next document is the next lower identifier (null lowest),
    then the next lower hash of the text; rows that repeat both are one document and get its result each. A sole
    document is its own next. Other columns are not read. An empty table gives no rows.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("fp_id"), text.alias("fp_text")).withColumn("fp_hash", F.xxhash64("fp_text"))
    keys = own.groupBy("fp_id", "fp_hash").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("fp_text")).cast("long").alias("n_chars"))
    order = written(in_order(keys, parts), "order")
    if not order.filter("copies > 1").isEmpty():
        own = own.dropDuplicates(["fp_id", "fp_hash"])
    # a null identifier is marked by a column of its own, so that joins are plain equalities
    flat = lambda df, i, h, p: df.withColumns({f"{p}_none": F.col(i).isNull(), f"{p}_key": F.coalesce(F.col(i), F.lit(0))}).withColumnRenamed(h, f"{p}_hash")
    at, to = ["at_none", "at_key", "at_hash"], ["to_none", "to_key", "to_hash"]
    order = flat(flat(order, "fp_id", "fp_hash", "at"), "next_id", "next_hash", "to")
    # both sides rename every column alike, so that Spark shuffles the texts once and uses that exchange twice
    side = lambda names, body: flat(own, "fp_id", "fp_hash", "at").select(*[F.col(a).alias(b) for a, b in zip(at, names, strict=True)], F.col("fp_text").alias(body))
    texts, follow = side(at, "own_text"), side(to, "next_text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    tails = order.select(*at, *to, "n_chars").join(follow, to).select(*at, "n_chars", F.expr("substring(next_text, 1, cast(n_chars div 2 as int))").alias("tail"))
    both = texts.join(tails, at)
    edited = F.concat(F.substring("own_text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("tail"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("own_text").alias("body")), F.struct(F.lit(1).alias("side"), edited.alias("body"))))
    sided = both.select(*at, sides.alias("s")).select(*at, "s.side", "s.body")
    drawn = samples(sided, [*at, "side"], "body", n)
    paired = drawn.groupBy(*at).agg(F.max(F.when(F.col("side") == 0, F.col("samples"))).alias("own"), F.max(F.when(F.col("side") == 1, F.col("samples"))).alias("other"))
    hashes = both.select(*at, F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    found = written(hashes.join(paired, at, "left"), "fingerprints")
    full = order.select(*at, *to, "fp_id", "n_chars", "copies").join(found, at)
    after = found.select(*[F.col(a).alias(b) for a, b in zip(at, to, strict=True)], F.col("own").alias("next_own"))
    full = full.join(after, to)
    out = full.select(
        F.col("fp_id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("fp_copy"),
    )
    return out.drop("fp_copy")
