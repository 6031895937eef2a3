"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _least(down: DataFrame) -> DataFrame:
    """``u, m``: each upper end and the least of its lower ones; pre-aggregated, so a node of any degree is safe."""
    return down.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(down: DataFrame) -> DataFrame:
    """Every edge, ``u`` over ``v``, hangs on the least neighbour of its lower end: on that end itself if it has none below."""
    least = _least(down).withColumnRenamed("u", "low")
    return down.join(least, down["v"] == least["low"], "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(down: DataFrame) -> DataFrame:
    """Every node and its lower neighbours hang on the least of these; repeated edges go."""
    linked = down.join(_least(down), "u").select("m", F.explode(F.array("u", "v")).alias("u"))
    return linked.select("u", F.col("m").alias("v")).filter("u != v").distinct()


def _settled(down: DataFrame) -> bool:
    """Whether the edges are stars: no node hangs on two, none that hangs has another hang on it."""
    ends = down.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs")))).alias("e")).select("e.*")
    met = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("least"))
    return met.filter("hangs > 1 or hangs > 0 and least = 0").isEmpty()


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``u, v``: every node of ``edges`` but the least of its component, once, with that least node.

    ``edges`` has ``u, v`` of one ordered type. Loops and repeated edges do no harm; a null end drops the edge. No edges give
    no rows. Every round is written to the shared folder and the one before removed; the rounds end when all components are
    stars. The first round reads ``edges`` more than once, so what is costly to make is better written before.
    """
    clean = edges.select("u", "v").filter("u is not null and v is not null and u != v")
    now = clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    for _ in range(most_rounds):
        last, now = now, written(_small_star(_large_star(now)), "edges")
        drop_written(last)
        if _settled(now):
            return now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges``, as for :func:`stars`; the component is its least node."""
    now = stars(edges, most_rounds)
    least = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(least)
