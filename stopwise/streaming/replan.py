"""Re-planning as points arrive: each micro-batch plans anew the problems that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import PlanConfig
from ..plans.planner import Planner

POINTS = "problem_id long, point_idx int, name string, lng double, lat double"


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key's last ``batch``, without that column."""
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"], "left_semi").drop("batch")


def current(spark: SparkSession, plans: str) -> DataFrame:
    """The stops of each problem's last plan."""
    return latest(spark.read.parquet(plans), ["problem_id"])


def replan(spark: SparkSession, incoming: str, store: str, plans: str, checkpoint: str, config: PlanConfig, interval: str = "1 minute") -> StreamingQuery:
    """Follows Parquet files of points in ``incoming``; keeps all points, by problem, in ``store`` and plans in ``plans``.

    A batch writes its own folder in both, so a repeated batch replaces what it wrote before.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        touched = rows.select("problem_id").distinct()
        known = latest(spark.read.parquet(store).filter(f"batch <= {number}").join(touched, "problem_id", "left_semi"), ["problem_id", "point_idx"])
        plan = Planner(spark, config).run(known)
        plan.stops.write.mode("overwrite").parquet(f"{plans}/batch={number}")

    stream = spark.readStream.schema(POINTS).parquet(incoming)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
