"""Commands: run, list, validate, init, display, compare, versus."""

from __future__ import annotations

import argparse
import importlib.util
import logging
import sys
import time

from scorelake import adapters, evaluators
from scorelake.config import Config, scaffold
from scorelake.operators import judging, report
from scorelake.sources import loaders


def listed(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def catalogue(config: Config, what: str = "all") -> dict[str, list[str]]:
    every = {"models": {*config.models, *adapters.MODELS}, "datasets": {*config.datasets, *loaders.LOADERS}, "evaluators": {*config.evaluators, *evaluators.EVALUATORS, *evaluators.JUDGED}}
    return {k: sorted(v) for k, v in every.items() if what in ("all", k)}


def environment() -> list[dict]:
    """Which libraries are there."""
    return [{"library": n, "found": importlib.util.find_spec(n) is not None} for n in ("pyspark", "pyarrow", "pandas", "numpy", "yaml", "duckdb")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scorelake", description="Scores model outputs on Spark.")
    p.add_argument("--config")
    p.add_argument("--log-level", default="INFO")
    p.add_argument("--log-file")
    commands = p.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="answer and score")
    for flag, name in (("-m", "--models"), ("-d", "--datasets")):
        run.add_argument(flag, name, required=True)
    run.add_argument("-e", "--evaluators")
    run.add_argument("-o", "--output", default="output")
    show = commands.add_parser("list", help="what is known")
    show.add_argument("what", nargs="?", default="all", choices=["models", "datasets", "evaluators", "all"])
    commands.add_parser("validate", help="check the environment")
    commands.add_parser("init", help="lay out a project").add_argument("path", nargs="?", default=".")
    commands.add_parser("display", help="show stored results").add_argument("path", nargs="?", default="output")
    compare = commands.add_parser("compare", help="win rates of two prediction files, by recorded verdicts or a judge")
    for name in ("--pred-a", "--pred-b"):
        compare.add_argument(name, required=True)
    versus = commands.add_parser("versus", help="answer with two models, where that isn't done yet, and compare them")
    versus.add_argument("models", nargs=2)
    versus.add_argument("-d", "--dataset", required=True)
    for command in (compare, versus):
        command.add_argument("--verdicts", help="JSON lines of id and verdict")
        command.add_argument("--judge", help="a model of the configuration")
        command.add_argument("--criteria", nargs="+", help="for a generic judge: what is compared")
        command.add_argument("--task", default="video description")
        command.add_argument("-o", "--output")
    compare.add_argument("--name-a", default="A")
    compare.add_argument("--name-b", default="B")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)] + ([logging.FileHandler(args.log_file)] if args.log_file else [])
    logging.basicConfig(level=args.log_level.upper(), handlers=handlers, force=True, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    config = Config.load(args.config) if args.config else Config()
    if args.command == "list":
        for kind, names in catalogue(config, args.what).items():
            print(f"{kind}: {', '.join(names)}")
        return 0
    if args.command == "validate":
        found = environment()
        print(report.grid(found))
        return int(not all(x["found"] for x in found))
    if args.command == "init":
        for path in scaffold(args.path):
            print(path)
        return 0
    from scorelake.pipeline import Benchmark
    from scorelake.session import session

    spark = session()
    if args.command == "display":
        rows = Benchmark(spark, config, args.path).results().orderBy("model", "dataset", "evaluator", "metric", "task").collect()
        print(report.grid([r.asDict() for r in rows]))
        return 0
    if args.command in ("compare", "versus"):
        bench = Benchmark(spark, config, args.output or "output")
        if args.command == "compare":
            a, b, names = loaders.predictions(spark, args.pred_a), loaders.predictions(spark, args.pred_b), (args.name_a, args.name_b)
        else:
            (a, b), names = (bench.predicted(m, args.dataset) for m in args.models), tuple(args.models)
        if not (args.verdicts or args.judge):
            raise SystemExit("a comparison needs --verdicts or --judge")
        judge = adapters.Recorded(spark.read.schema("id string, verdict string").json(args.verdicts), ["id"], "verdict") if args.verdicts else bench.adapter(args.judge)
        began = time.monotonic()
        judged_rows, rates = compare(a, b, judge, args.task, args.criteria)
        if args.output:
            judged_rows.write.mode("overwrite").json(f"{args.output}/detailed_results")
            judged_rows = spark.read.schema(judged_rows.schema).json(f"{args.output}/detailed_results")
            summary = rates(judged_rows) if args.criteria else judging.ranking_report(judged_rows, args.task, *names, time.monotonic() - began)
            summary.coalesce(1).write.mode("overwrite").json(f"{args.output}/summary")
        print(f"A: {names[0]}, B: {names[1]}")
        print(report.grid([r.asDict() for r in rates(judged_rows).collect()]))
        return 0
    bench = Benchmark(spark, config, args.output)
    rows = bench.run(listed(args.models), listed(args.datasets), listed(args.evaluators)).collect()
    if rows:
        bench.save_summary()
        print(report.grid([r.asDict() for r in rows]))
    return 0


def compare(a, b, judge, task: str = "video description", criteria: list[str] | None = None):
    """Verdicts on the ids that two tables of predictions share, and what sums them up: win rates by category with an OVERALL row; with criteria, a generic judge's counts by category."""
    from pyspark.sql import functions as F

    from scorelake import judged

    sides = [p.select("id", "pos", "source", F.get("prompt", 0).alias("question"), F.get("prediction", 0).alias("text")) for p in (a, b)]
    if judging.common(*(judging.latest(p, "id", ["pos"]).select("id", "text") for p in sides)).isEmpty():
        raise ValueError("the files have no id in common")
    if criteria:
        return judged.compared(*sides, judge, criteria), lambda rows: judging.pairwise_stats(rows, "category")
    return judged.ranked(*(p.drop("question") for p in sides), judge, task), judging.win_rates_by_category


if __name__ == "__main__":
    sys.exit(main())
