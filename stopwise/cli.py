"""``python -m stopwise.cli plan|compare CONFIG --out DIR [--set a.b=c] [--strategies tsp,cluster] [--tag NAME]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import summary, to_yaml
from .plans import exports
from .plans.planner import Planner
from .registers import EXPORTERS


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stopwise")
    parser.add_argument("command", choices=["plan", "compare"])
    parser.add_argument("config")
    parser.add_argument("--out", default="out")
    parser.add_argument("--tag", default="")
    parser.add_argument("--set", action="append", default=[], metavar="a.b=c")
    parser.add_argument("--strategies", default="tsp,cluster")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("stopwise").getOrCreate()
    planner = Planner(spark, args.config, dict(s.split("=", 1) for s in args.set))
    out = f"{args.out}/{args.tag}" if args.tag else args.out
    print(summary(planner.config))
    if args.command == "compare":
        table = planner.compare(args.strategies.split(","))
        table.write.mode("overwrite").json(f"{out}/comparison")
        table.orderBy("problem_id", "metric").show(100, False)
        return 0
    plan = planner.run()
    spark.createDataFrame([(to_yaml(planner.config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/config_used")
    made = {name: exporter(plan) for name, exporter in EXPORTERS.known.items()}
    made.pop("json").write.mode("overwrite").json(f"{out}/plan")
    exports.write_rows(made.pop("rows"), f"{out}/rows")
    for name, table in made.items():
        table.write.mode("overwrite").format("parquet" if name == "report" else "json").save(f"{out}/{name}")
    plan.metrics.show(20, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
