"""Command line: models, suites, similar, duplicates, evaluate, benchmark."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ticketloom.api import Engine
from ticketloom.config import Settings
from ticketloom.plans.pipelines import MODELS, SUITES
from ticketloom.sinks.reports import ResultsWriter, metric_table, render, search_table


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ticketloom", description="Similar and duplicate records in issue collections")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("models", help="list the models")
    sub.add_parser("suites", help="list the benchmark suites")
    for name in ("similar", "duplicates", "evaluate", "benchmark"):
        c = sub.add_parser(name)
        for flag in ("source", "path", "jdbc-url", "jdbc-user", "jdbc-password", "results-dir"):
            c.add_argument(f"--{flag}")
        c.add_argument("--limit", type=int)
        c.add_argument("--partitions", type=int, help="connections to read a database table with")
        c.add_argument("--vectors", action="append", default=[], metavar="SPACE=PATH", help="Parquet table (issue_id, vector) of a precomputed space: sbert, e5 or dense")
        c.add_argument("--exclude-query-edges", action="store_true", help="keep a query's own links out of the graph evidence")
        c.add_argument("--disable-training-diagnostics", action="store_true", help="write no loss curves of fitted networks")
        c.add_argument("--pool", type=int)
        if name in ("similar", "duplicates"):
            c.add_argument("--model", default="bm25")
            c.add_argument("--top-k", type=int, default=10)
            c.add_argument("--title", required=True)
            c.add_argument("--query-vectors", action="append", default=[], metavar="SPACE=PATH", help="Parquet table (issue_id = 0, vector) of the record asked for")
            for flag in ("description-text", "project-key", "issue-type", "priority", "status"):
                c.add_argument(f"--{flag}")
            for flag in ("component", "affected-version", "fix-version", "comment"):
                c.add_argument(f"--{flag}", action="append", default=[])
        if name == "duplicates":
            c.add_argument("--threshold", type=float, default=0.55)
        if name == "evaluate":
            c.add_argument("--task", choices=("similarity", "duplicates"), default="similarity")
            c.add_argument("--models", nargs="*")
        if name == "benchmark":
            c.add_argument("--suite", choices=sorted(SUITES), required=True)
        if name in ("evaluate", "benchmark"):
            c.add_argument("--sample-size", type=int, default=100)
            c.add_argument("--folds", type=int, default=5)
    return p


def build_query(spark: SparkSession, a: argparse.Namespace):
    row = (0, a.title, a.description_text, a.project_key, a.issue_type, a.priority, a.status, a.component, a.affected_version, a.fix_version, a.comment)
    return spark.createDataFrame([row], "qid long, title string, description_text string, project_key string, issue_type string, priority string, status string, components array<string>, affected_versions array<string>, fix_versions array<string>, comments array<string>")


def read_vectors(spark: SparkSession, given: Sequence[str]) -> dict:
    """Spaces given as name=path, with vectors as doubles."""
    pairs = (g.split("=", 1) for g in given)
    return {name: spark.read.parquet(path).selectExpr("issue_id", "CAST(vector AS array<double>) AS vector") for name, path in pairs}


def main(argv: Sequence[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    a = build_parser().parse_args(argv)
    if a.command == "models":
        print("\n".join(f"{m.name:24} {m.family:12} {m.description}" for m in MODELS.values()))
        return 0
    if a.command == "suites":
        print("\n".join(f"{n:34} {', '.join(models)}" for n, (_, models) in SUITES.items()))
        return 0
    settings = Settings.from_env().with_overrides(source=a.source, path=a.path, jdbc_url=a.jdbc_url, jdbc_user=a.jdbc_user, jdbc_password=a.jdbc_password, limit=a.limit, partitions=a.partitions, pool=a.pool, results_dir=a.results_dir, diagnostics=False if a.disable_training_diagnostics else None)
    spark = SparkSession.builder.appName("ticketloom").getOrCreate()
    engine = Engine.from_source(spark, settings, vectors=read_vectors(spark, a.vectors), exclude_query_edges=a.exclude_query_edges)
    writer = ResultsWriter(settings.results_dir)
    if a.command in ("similar", "duplicates"):
        found = engine.search_new(build_query(spark, a), a.model, a.top_k, read_vectors(spark, a.query_vectors))
        if a.command == "duplicates":
            found = found.where(found["score"] >= a.threshold)
        found = found.cache()
        print("\n".join(render(found)) or "no match")
        writer.save(a.command, a.model, found, search_table(found))
        return 0
    if a.command == "evaluate":
        metrics, name, skipped = engine.evaluate(a.task, a.models, a.sample_size, folds=a.folds), a.task, []
    else:
        metrics, _, skipped = engine.run_suite(a.suite, sample_size=a.sample_size, folds=a.folds)
        name = a.suite
    metrics = metrics.cache()
    report = metric_table(metrics) + (f"\n\nSkipped: {', '.join(skipped)}" if skipped else "")
    print(report)
    writer.save(a.command, name, metrics, report)
    return 0


if __name__ == "__main__":
    sys.exit(main())
