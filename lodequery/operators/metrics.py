"""Operational metrics over event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodequery.operators.folds import clamped_totals

SAMPLES = 5000


def latency_percentiles(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], percents: Sequence[int] = (50, 95, 99), samples: int = SAMPLES) -> DataFrame:
    """Count, total, least, greatest, mean and percentiles of the last ``samples`` values of each group, 3 decimals; a
    percentile is the value at place floor(p / 100 * n) of the sorted values. The window keeps a bounded number of rows
    of a group, already on the map side."""
    last = df.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order]))).where(F.col("_n") <= samples)
    sorted_values = F.array_sort(F.collect_list(value))  # at most ``samples`` values
    each = last.groupBy(*by).agg(F.count("*").alias("count"), F.sum(value).alias("total"), F.min(value).alias("min"), F.max(value).alias("max"), sorted_values.alias("_v"))
    out = each.withColumn("avg", F.col("total") / F.col("count"))
    for p in percents:
        out = out.withColumn(f"p{p}", F.element_at("_v", F.least(F.floor(F.lit(p) * F.col("count") / 100), F.col("count") - 1).cast("int") + 1))
    names = ["total", "min", "max", "avg", *[f"p{p}" for p in percents]]
    return out.select(*by, "count", *[F.round(c, 3).alias(c) for c in names])


def counters(df: DataFrame, by: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v.lower()}") for v in values])


def health(summary: DataFrame, severities: DataFrame) -> DataFrame:
    """One row: DEGRADED with a critical event, or with failures of more than twice the completions."""
    s = summary.agg(F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "COMPLETED").alias("completed"))
    c = severities.agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    bad = (F.col("critical") > 0) | ((F.col("failed") > 0) & (F.col("failed") > 2 * F.col("completed")))
    return s.join(c).select("failed", "completed", "critical", F.when(bad, "DEGRADED").otherwise("HEALTHY").alias("health"))  # one row and one row


def active_sessions(events: DataFrame, stage: str, order: Sequence[str], by: str | None = None) -> DataFrame:
    """``created, completed, failed, stopped, active``: session events by stage, and those active after the last event,
    which an end without a beginning never takes below 0. One row, or one for each value of ``by``."""
    key = F.col(by) if by else F.lit("")
    change = F.when(F.col(stage) == "created", 1.0).when(F.col(stage).isin("completed", "failed", "stopped"), -1.0).otherwise(0.0)
    rows = events.select(key.alias("_by"), *order, F.col(stage).alias("_stage"), change.alias("_change"))
    last = clamped_totals(rows, "_by", "_change", list(order), 0.0, 0.0, float("inf"), "active")
    counts = rows.groupBy("_by").agg(*[F.count_if(F.col("_stage") == s).alias(s) for s in ("created", "completed", "failed", "stopped")])
    both = counts.join(last, "_by")
    return both.select(*([F.col("_by").alias(by)] if by else []), "created", "completed", "failed", "stopped", F.col("active").cast("bigint").alias("active"))


def session_states(sessions: DataFrame) -> DataFrame:
    """One row: ``total, active`` and the counts by status; active are those running or waiting for approval."""
    status = F.col("status")
    named = {s.lower(): s for s in ("COMPLETED", "FAILED", "STOPPED", "RUNNING")}
    return sessions.agg(F.count("*").alias("total"), F.count_if(status.isin("RUNNING", "WAITING_FOR_APPROVAL")).alias("active"), *[F.count_if(status == v).alias(n) for n, v in named.items()])


def log_counters(log: DataFrame) -> DataFrame:
    """One row: actions of a log by ``event_type`` or, if there, ``stage`` and ``result``, and entries by severity."""
    at = lambda t, stage: (F.col("event_type") == t) | (F.coalesce(F.col("stage") == stage, F.lit(False)) if "stage" in log.columns else F.lit(False))
    failed = (F.col("event_type") == "ACTION_FAILED") | (F.coalesce(F.col("result") == "failure", F.lit(False)) if "result" in log.columns else F.lit(False))
    marks = {"proposed": at("ACTION_PROPOSED", "ACTION_PROPOSED"), "executed": at("ACTION_EXECUTED", "ACTION_EXECUTED"), "blocked": at("ACTION_BLOCKED", "ACTION_DENIED"), "failed": failed}
    return log.agg(*[F.count_if(c).alias(n) for n, c in marks.items()], *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])


def security_counts(events: DataFrame) -> DataFrame:
    """``severity, category, events, alerts``: alerts are marked ones (``alert``) and those of high or critical severity."""
    marked = F.coalesce(F.col("alert"), F.lit(False)) if "alert" in events.columns else F.lit(False)
    return events.groupBy("severity", "category").agg(F.count("*").alias("events"), F.count_if(marked | F.col("severity").isin("HIGH", "CRITICAL")).alias("alerts"))
