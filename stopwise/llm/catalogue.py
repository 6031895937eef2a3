"""The numbered queries over the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, extract, fingerprint, mixing, neardup, packing, quality, sharding, sstable, substrings, toxicity, urls, variants
from .common import table
from .tokens import default_file


def op1_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = lambda key: F.crc32(key.cast("string").cast("binary")) % 3
    scored = toxicity.score(docs, toxicity.train(docs, labels, usable=fold(F.col("key")) != 1))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def op2_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_tables(table(spark, sf_dir, "documents"), default_file("word_bpe_49k.json"))
    return sstable.read_tables(manifest)


def op3_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.two_pass_shuffle(table(spark, sf_dir, "documents"), 40)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return shards.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.RULES)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_recurrent_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


def op7_consistent_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_file("byte_bpe_50k.json"))


def op9_poisson_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.round("mix_rate", 9).alias("mix_rate"), "mix_copy", "mix_order")


def op10_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_vocabulary_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op13_parity_mask_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_string_kernel_toxicity,
        op2_sorted_string_tables,
        op3_two_pass_shuffle,
        op4_redirect_equivalence,
        op5_minhash_near_dedup,
        op6_recurrent_block_labeller,
        op7_consistent_weighted_sampling,
        op8_best_fit_packing,
        op9_poisson_replication,
        op10_robust_outliers,
        op11_vocabulary_automaton,
        op12_super_kmer_dedup,
        op13_parity_mask_variants,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_redirect_equivalence": urls.ORACLE,
        "op5_minhash_near_dedup": neardup.ORACLE,
        "op9_poisson_replication": mixing.ORACLE,
        "op11_vocabulary_automaton": divergence.ORACLE,
        "op12_super_kmer_dedup": substrings.ORACLE,
        "op13_parity_mask_variants": variants.ORACLE,
    }
