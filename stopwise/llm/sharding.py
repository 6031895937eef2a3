"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into memory-sized buckets by seeded hashes, every shard being a run of buckets; pass two
puts each bucket in canonical order, gives it a Fisher-Yates shuffle (Spark's ``shuffle`` function) and writes it. The
law is ``key``: identifier and shard count alone decide the shard, by the jump rule of Lamping and Veach (2014) with a
hash for each step, so one shard more takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, written

#: Bytes of records that a bucket holds on average: at least the first, at most the second, between them as many as make
#: MOST_BUCKETS of the input. Pass two keeps one bucket per task in memory.
BUCKET_BYTES, LARGEST_BUCKET, MOST_BUCKETS = 8 << 20, 256 << 20, 10_000


def _unit(*cols: Column) -> Column:
    """A uniform double in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * (2.0**-53)


def shard_of(key: Column, n_shards: int, seed: int = 0) -> Column:
    """Shard from 0 to ``n_shards - 1``: the last step j at which the key jumps, which it does with chance 1/(j+1)."""
    jumps = [F.when(_unit(key, F.lit(seed), F.lit(j)) * (j + 1) < 1.0, F.lit(j)) for j in range(1, n_shards)]
    return F.greatest(F.lit(0), F.lit(0), *jumps)


def _numbered(records: DataFrame) -> DataFrame:
    """Adds ``copy``: rows that repeat identifier and text are numbered from 1, all others have 1.

    Repeated rows are found by hash alone, and only if there are any are their texts met: each once, with its count, from
    which the copies are made again. So a row that is a third of the table goes to no single task.
    """
    records = records.withColumn("same", F.xxhash64("doc_id", "text"))
    repeated = records.groupBy("doc_id", "same").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = written(repeated, "repeated")
    if repeated.isEmpty():
        return records.drop("same").withColumn("copy", F.lit(1).cast("long"))
    met = (records["doc_id"].eqNullSafe(repeated["doc_id"])) & (records["same"] == repeated["same"])
    alone = records.join(repeated, met, "left_anti").drop("same").withColumn("copy", F.lit(1).cast("long"))
    once = records.join(repeated, met, "left_semi").groupBy("doc_id", "text", "size").agg(F.count(F.lit(1)).alias("n"))
    return alone.union(once.select("doc_id", "text", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")))


def two_pass_shuffle(
    docs: DataFrame,
    n_shards: int = 40,
    seed: int = 17,
    path: str | None = None,
    bucket_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Writes all records into shards as Parquet under ``path`` and returns them as read back.

    Columns: ``doc_id, text, size, shard, bucket, slot, grown_shard``. A null text takes 16 bytes and stays null; a null
    identifier is a key like any other; repeated rows and ids are kept, each in a slot of its own, and rows with one
    identifier share a shard. Buckets are chosen by identifier, text and the number of the copy, so copies of one text, and
    of one row, spread evenly. Slots run from 0 without gaps in every shard. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    key, text = F.col(id_col).cast("long"), F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    records = docs.select(key.alias("doc_id"), text.alias("text"), size.alias("size"))
    total = records.agg(F.sum("size")).first()[0] or 0
    bucket_bytes = bucket_bytes or min(LARGEST_BUCKET, max(BUCKET_BYTES, total // MOST_BUCKETS))
    per_shard = max(1, -(-total // (n_shards * bucket_bytes)))
    records = _numbered(records)
    keyed = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    within = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text", "copy"), F.lit(per_shard)).cast("int")
    records = records.withColumns({"shard": shard_of(keyed, n_shards, seed), "grown_shard": shard_of(keyed, n_shards + 1, seed)})
    records = records.withColumn("bucket", F.col("shard") * per_shard + within)
    scattered = records.repartitionById(n_shards * per_shard, F.col("bucket"))
    fields = ["doc_id", "text", "size", "grown_shard"]
    # one bucket is one partition, and its rows are in canonical order before the seeded shuffle, so a repeated task gives the same slots
    bucketed = scattered.groupBy("shard", "bucket").agg(F.shuffle(F.sort_array(F.collect_list(F.struct(*fields))), seed).alias("rows"))
    shuffled = bucketed.select("shard", "bucket", F.posexplode("rows").alias("at", "row")).select("shard", "bucket", "at", "row.*")
    shuffled.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(shuffled.schema).parquet(path)
    counts = back.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return back.join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("base") + F.col("at")).cast("long")).drop("base", "at")
