"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate, target share x budget / its own size. A document is repeated as often as the
inverse of the Poisson distribution with that mean says at a uniform that is hashed from seed and document, so a
document's count depends on nothing but itself and its source's rate. The inverse is a table for each source, with a guide
into it. All copies are then shuffled globally.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Target shares go with a source's size to this power: large sources lose to small ones, none is left out.
TEMPER = 0.7


def unit_hash(seed: int, *cols: Column) -> Column:
    """A uniform double in [0, 1) from 48 bits of an MD5 digest, the same in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


_LADDER = ("mix_least", "mix_steps", "mix_guide")
#: Bytes of text that a partition of the mixture holds, if the session's number of shuffle partitions does not make them smaller.
PARTITION_BYTES = 128 << 20
#: Slices of the unit interval for each of which a source's table says where to look.
SLICES = 256
#: Logarithms of k! below 20; above, Stirling's series is exact to rounding.
_SMALL_FACTORIALS = [math.lgamma(k + 1) for k in range(20)]


def _log_factorial(k: Column) -> Column:
    x = F.greatest(k, F.lit(20)).cast("double")
    series = x * F.ln(x) - x + F.ln(x * (2 * math.pi)) / 2 + 1 / (x * 12) - 1 / (F.pow(x, 3.0) * 360) + 1 / (F.pow(x, 5.0) * 1260)
    return F.when(k < 20, F.get(F.array(*map(F.lit, _SMALL_FACTORIALS)), F.least(k, F.lit(19)).cast("int"))).otherwise(series)


def with_ladder(rows: DataFrame, mean: str) -> DataFrame:
    """Adds the cumulative Poisson probabilities of each row's ``mean`` and a guide into them: made once for each source.

    ``mix_least`` is the first count of the table, ``mix_steps`` the cumulative probabilities from it on (twelve deviations
    and thirty to either side; what lies beyond is under 10^-30), ``mix_guide`` for each slice how many of them are at most
    its lower end. Below a mean of some 170 the table starts at 0.
    """
    m = F.col(mean)
    width = F.sqrt(m) * 12 + 30
    rows = rows.withColumn("mix_least", F.greatest(F.lit(0), F.floor(m - width)).cast("long"))
    least = F.col("mix_least")
    first = F.when(least == 0, F.exp(-m)).otherwise(F.exp(least * F.ln(F.greatest(m, F.lit(1e-300))) - m - _log_factorial(least)))
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))
    rows = rows.withColumn("mix_start", start).withColumn("mix_last", F.ceil(m + width).cast("long"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * m / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.array_append(acc["all"], acc["c"] + p).alias("all"))

    terms = F.aggregate(F.sequence(least + 1, F.col("mix_last")), F.col("mix_start"), step, lambda acc: acc["all"])
    rows = rows.withColumn("mix_steps", terms).drop("mix_start", "mix_last")
    guide = F.transform(F.sequence(F.lit(0), F.lit(SLICES)), lambda j: F.size(F.filter("mix_steps", lambda c: c <= j / SLICES)))
    return rows.withColumn("mix_guide", guide)


def poisson_inverse(u: Column) -> Column:
    """The least k whose cumulative probability exceeds ``u``, from the table of :func:`with_ladder`."""
    at = F.floor(u * SLICES).cast("int")
    lo, hi = F.get("mix_guide", at), F.get("mix_guide", at + 1)
    inside = F.size(F.filter(F.slice("mix_steps", lo + 1, hi - lo), lambda c: c <= u))
    return (F.col("mix_least") + lo + F.when(hi > lo, inside).otherwise(0)).cast("int")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, temper: float = TEMPER, source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, int]:
    """``mix_source, mix_rate``, one short row per source, and the bytes of all texts. ``budget`` is the size of the mixture in sizes of the input.

    ``weights`` names target shares; a source that it does not name gets none. Without it, shares go with size to the
    power ``temper``. Size is bytes of text; a null source is the source ''.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source")
    sized = docs.select(source, F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("size"))
    sizes = written(sized.groupBy("mix_source").agg(F.sum("size").alias("size")), "sizes")
    if weights is None:
        share = F.pow("size", F.lit(temper))
    else:
        share = F.coalesce(F.lit(0.0), F.lit(0.0))
        for name, w in weights.items():
            share = F.when(F.col("mix_source") == name, F.lit(float(w))).otherwise(share)
    shares = sizes.select("mix_source", "size", F.when(F.col("size") > 0, share).otherwise(0.0).alias("share"))
    whole = shares.agg(F.sum("share").alias("shares"), F.sum("size").alias("sizes")).first()
    rate = F.col("share") / F.lit(float(whole.shares or 1.0)) * F.lit(float(whole.sizes or 0.0) * budget) / F.col("size")
    found = written(shares.select("mix_source", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("mix_rate")), "rates")
    drop_written(sizes)
    return found, int(whole.sizes or 0)


def replicate(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    budget: float = 1.0,
    seed: int = 23,
    temper: float = TEMPER,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as drawn, in a global random order.

    Added columns: ``mix_copy`` (from 1), ``mix_rate`` and ``mix_order``, a uniform number by which the result is sorted
    over all its partitions; existing columns of these names, and of the three of :func:`with_ladder`, are replaced, all others
    are kept. Identifier and text seed the draw, so rows
    that repeat both are drawn alike. A null source is a source of its own; sources without text are dropped, having no
    rate. An empty table gives no rows. Rates reach the rows through a join that Spark sends to all tasks only if the
    table of sources is small.
    """
    docs = docs.drop("mix_rate", "mix_copy", "mix_order", *_LADDER)
    found = rates(docs, weights, budget, temper, source_col, text_col)
    taken = {c.lower() for c in docs.columns}
    own = lambda name: next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken)
    source, digest, count = own("mix_source"), own("mix_digest"), own("mix_n")
    found, size = found
    found = with_ladder(found, "mix_rate").withColumnRenamed("mix_source", source)
    keyed = docs.withColumn(source, F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    keyed = keyed.join(written(found, "ladders"), source).withColumn(digest, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    copies = poisson_inverse(unit_hash(seed, F.col(id_col), F.col(digest)))
    drawn = keyed.withColumn(count, copies).drop(*_LADDER, source).filter(F.col(count) > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col(count))))
    order = unit_hash(seed + 1, F.col(id_col), F.col(digest), F.col("mix_copy"))
    spread = drawn.withColumn("mix_order", order).drop(count, digest)
    # the key is uniform, so equal slices of [0, 1) are equal partitions: no sampling, and one shuffle
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size * budget / PARTITION_BYTES))
    return spread.repartitionById(n, F.floor(F.col("mix_order") * n).cast("int")).sortWithinPartitions("mix_order")


ORACLE = f"""
with sized as (
  select coalesce(source, '') as mix_source, sum(strlen(coalesce(text, ''))) as size from documents group by 1),
shares as (select mix_source, size, case when size > 0 then pow(size, {TEMPER}) else 0 end as share from sized),
rated as (
  select mix_source, case when size > 0 then share / (select sum(share) from shares) * (select sum(size) from sized) / size else 0 end as mix_rate
  from shares),
drawn as (
  select doc_id, source, mix_rate, md5(coalesce(text, '')) as digest,
    ('0x' || substr(md5('23|' || doc_id || '|' || md5(coalesce(text, ''))), 1, 12))::bigint / 281474976710656.0 as u
  from documents join rated on coalesce(source, '') = mix_source),
ladder as (
  select doc_id, digest, source, mix_rate, u, 0 as k, exp(-mix_rate) as p, exp(-mix_rate) as c from drawn),
counted as (
  with recursive steps as (
    select doc_id, digest, source, mix_rate, u, k, p, c from ladder
    union all
    select doc_id, digest, source, mix_rate, u, k + 1, p * mix_rate / (k + 1), c + p * mix_rate / (k + 1) from steps where u >= c and k < 200)
  select doc_id, digest, source, mix_rate, max(k) as n from steps group by all)
select doc_id, source, round(mix_rate, 9) as mix_rate, copy::int as mix_copy,
  ('0x' || substr(md5('24|' || doc_id || '|' || digest || '|' || copy), 1, 12))::bigint / 281474976710656.0 as mix_order
from counted, unnest(range(1, n + 1)) as t(copy)
"""
