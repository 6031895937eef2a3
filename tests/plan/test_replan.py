"""Re-planning by micro-batches, and the registers of plug-ins."""

import pytest

from stopwise.config import Constraints, PlanConfig
from stopwise.plans.planner import Planner
from stopwise.registers import DISTANCES, READERS
from stopwise.sources import tables
from stopwise.streaming import replan


def test_last_version_of_a_point_counts(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    config = PlanConfig(constraints=Constraints(max_daily_points=2))
    rows = [[(1, 0, "a", 107.0, 29.8), (1, 1, "b", 107.01, 29.8), (2, 0, "z", 107.0, 29.9)], [(1, 1, "b", 107.5, 29.9), (1, 2, "c", 107.02, 29.8)]]
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, replan.POINTS).coalesce(1).write.mode("append").parquet(at("in"))
        query = replan.replan(spark, at("in"), at("store"), at("plans"), at("ck"), config, "1 second")
        query.processAllAvailable()
        query.stop()
    known = replan.latest(spark.read.parquet(at("store")), ["problem_id", "point_idx"])
    assert sorted((r.problem_id, r.point_idx, r.lng) for r in known.collect()) == [(1, 0, 107.0), (1, 1, 107.5), (1, 2, 107.02), (2, 0, 107.0)]
    stops = replan.current(spark, at("plans")).collect()
    assert sorted((r.problem_id, r.point_idx) for r in stops) == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_plug_ins_by_name(spark, tmp_path):
    @READERS.register("pairs")
    def _pairs(session, path):
        return session.createDataFrame([("p", 0)], "name string, row_no long")

    assert tables.read_table(spark, "x.pairs").first().name == "p"
    with pytest.raises(ValueError, match="no distance provider nowhere; there are haversine, road"):
        DISTANCES.pick("nowhere")
    spark.createDataFrame([("depot", 107.08, 29.85)], "name string, lng double, lat double").write.parquet(str(tmp_path / "gaz"))
    config = PlanConfig()
    config.base_point.name = "depot"
    config.strategy.options["gazetteer"] = str(tmp_path / "gaz")
    points = spark.createDataFrame([(1, 0, "a", 107.0, 29.8)], replan.POINTS)
    assert Planner(spark, config)._with_base(points).base_point.lat == 29.85


def test_rows_are_numbered_over_files(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    spark.range(0, 1000, 1, 4).selectExpr("cast(id as string) as name").write.option("header", True).csv(path)
    got = tables.read_table(spark, path, "csv").collect()
    assert sorted(r.row_no for r in got) == list(range(1000))
