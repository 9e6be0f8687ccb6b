"""Results as JSON tables and Markdown reports."""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a report that a reader sees; the JSON table beside it always holds all.
REPORT_ROWS = 200
TITLE = 60


def _cell(v) -> str:
    if v is None:
        return ""
    if isinstance(v, float):
        return f"{v:.4f}"
    return ("; ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)).replace("|", "\\|").replace("\n", " ")


def markdown(columns: list[str], rows: list) -> str:
    """A Markdown table."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(_cell(r[c]) for c in columns) + " |" for r in rows])


def search_table(found: DataFrame) -> str:
    shown = found.withColumn("title", F.substring("title", 1, TITLE)).orderBy("qid", "rank").limit(REPORT_ROWS)
    return markdown(["qid", "rank", "issue_id", "issue_key", "title", "score", "reasons"], shown.collect())


def metric_pivot(metrics: DataFrame, ks: list[int]) -> DataFrame:
    """(model, task, metric, one column per cut-off) of metrics (model, task, metric, k, value)."""
    return metrics.groupBy("model", "task", "metric").pivot("k", ks).agg(F.first("value"))


def metric_table(metrics: DataFrame) -> str:
    """Metrics of several models with one column per cut-off."""
    ks = [r.k for r in metrics.select("k").distinct().orderBy("k").collect()]
    # Models x metrics rows, however large the collection is.
    return markdown(["model", "task", "metric", *map(str, ks)], metric_pivot(metrics, ks).orderBy("model", "metric").collect())


def render(found: DataFrame) -> list[str]:
    """One line per match for a console."""
    line = F.format_string("%d. [%s] %s (%.4f)", F.col("rank"), F.coalesce("issue_key", F.lit("?")), F.substring(F.coalesce("title", F.lit("")), 1, TITLE), F.col("score"))
    return [r[0] for r in found.orderBy("qid", "rank").limit(REPORT_ROWS).select(line).collect()]


class ResultsWriter:
    """Writes <root>/<command>/<time>_<name>/: data as JSON (by Spark) and report.md."""

    def __init__(self, root: str):
        self.root = root

    def save(self, command: str, name: str, data: DataFrame, report: str) -> str:
        at = f"{self.root}/{command}/{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}_{name}"
        data.write.json(at + "/data")
        local = at.removeprefix("file://")
        if "://" in local:
            data.sparkSession.createDataFrame([(report,)], "value string").coalesce(1).write.text(at + "/report.md")
        else:
            os.makedirs(local, exist_ok=True)
            with open(os.path.join(local, "report.md"), "w", encoding="utf-8") as out:
                out.write(report + "\n")
        return at
