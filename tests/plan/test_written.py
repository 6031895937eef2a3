"""A provider's table is made once for a plan, whatever number of steps read it."""

from pyspark.sql import functions as F

from stopwise.config import Constraints, PlanConfig
from stopwise.operators import pairs
from stopwise.plans.planner import Planner
from stopwise.registers import DISTANCES


def test_provider_is_asked_once(spark):
    asked = []

    @DISTANCES.register("counted_for_test")
    def _counted(points, config):
        asked.append(1)
        return pairs.pairs(points).withColumn("km", F.col("km") + 1.0)

    points = spark.createDataFrame([(1, k, f"p{k}", 107.0 + k / 100, 29.8) for k in range(6)], "problem_id long, point_idx int, name string, lng double, lat double")
    config = PlanConfig(constraints=Constraints(max_daily_points=3))
    config.distance.provider = "counted_for_test"
    plan = Planner(spark, config).run(points, "cluster")
    assert plan.stops.count() == 6 and plan.unassigned.count() == 0 and len(asked) == 1
    DISTANCES.known.pop("counted_for_test")
