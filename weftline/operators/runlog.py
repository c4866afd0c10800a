"""Summaries of call logs, rule profiles and plan runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0.0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(100.0 * part / whole)


def calls_summary(calls: DataFrame, *by: str) -> DataFrame:
    """Totals of a call log, in one aggregation; tokens and costs skip nulls."""
    n, hits = F.count("*"), F.count_if("cache_hit")
    return calls.groupBy(*by).agg(
        n.alias("total"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        hits.alias("cache_hits"),
        F.count_if(~F.col("cache_hit")).alias("cache_misses"),
        percent(hits, n).alias("hit_rate"),
        F.count_if("script_generated").alias("generated"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("mean_ms"),
        F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
    )


def month_of(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM")


def calls_between(calls: DataFrame, start: str, end: str) -> DataFrame:
    """Calls in the closed range; where `month` is a partition column, its folders are pruned too."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    out = calls.filter(F.col("ts").between(a, b))
    return out.filter(F.col("month").between(F.date_format(a, "yyyy-MM"), F.date_format(b, "yyyy-MM"))) if "month" in calls.columns else out


def profile_by_rule(runs: DataFrame) -> DataFrame:
    """Executions, mean and total ms and the sorted phases of each rule; runs: (rule, phase, ms)."""
    return runs.groupBy("rule").agg(F.count("*").alias("executions"), F.avg("ms").alias("mean_ms"), F.sum("ms").alias("total_ms"), F.array_join(F.array_sort(F.collect_set("phase")), ",").alias("phases"))


def profile_overall(runs: DataFrame) -> DataFrame:
    """Mean over all executions, and the slowest and fastest rule by mean (the smallest name at a tie)."""
    means = runs.groupBy("rule").agg(F.avg("ms").alias("mean"), F.sum("ms").alias("sum"), F.count("*").alias("n"))
    return means.agg((F.sum("sum") / F.sum("n")).alias("mean_ms"), F.min_by("rule", F.struct((-F.col("mean")).alias("a"), "rule")).alias("slowest"), F.min_by("rule", F.struct("mean", "rule")).alias("fastest"))


def unused_rules(registered: DataFrame, runs: DataFrame) -> DataFrame:
    return registered.select("rule").distinct().join(runs.select("rule"), "rule", "left_anti")


def utilisation(registered: DataFrame, runs: DataFrame) -> DataFrame:
    used = registered.select("rule").distinct().join(runs.select("rule").distinct().withColumn("used", F.lit(True)), "rule", "left")
    n, k = F.count("*"), F.count("used")
    return used.agg(n.alias("registered"), k.alias("executed"), percent(k, n).alias("utilisation"))


def progress(runs: DataFrame) -> DataFrame:
    """Distinct files and executions of each rule; runs: (rule, file)."""
    return runs.groupBy("rule").agg(F.countDistinct("file").alias("files"), F.count("*").alias("executions"))


def progress_summary(runs: DataFrame) -> DataFrame:
    return progress(runs).agg(F.count("*").alias("rules"), F.sum("executions").alias("executions"), F.count_if(F.col("files") > 0).alias("rules_with_files"))


def first_triggers(runs: DataFrame, order: str = "seq") -> DataFrame:
    """Each rule's first file and the rule's number in the order of first triggers.

    The first rows are partial aggregates; the one global window is over a row a rule.
    """
    first = runs.groupBy("rule").agg(F.min_by(F.struct(order, "file"), F.struct(order, "file")).alias("f"))
    place = F.row_number().over(Window.orderBy(F.col(f"f.{order}"), "rule")).cast("long")
    return first.select("rule", F.col(f"f.{order}").alias(order), "f.file", place.alias("place"))


def plan_progress(runs: DataFrame) -> DataFrame:
    """Per plan: phases, complete phases, tasks, tasks that succeeded and failed, and a status."""
    t = runs.groupBy("plan", "phase", "task").agg(F.bool_and(F.col("status") == "SUCCESS").alias("ok"), F.bool_or(F.col("status") == "FAILED").alias("bad"))
    p = t.groupBy("plan", "phase").agg(F.count("*").alias("tasks"), F.count_if("ok").alias("ok"), F.count_if("bad").alias("bad"))
    out = p.groupBy("plan").agg(F.count("*").alias("phases"), F.count_if(F.col("ok") == F.col("tasks")).alias("phases_complete"), F.sum("tasks").alias("tasks"), F.sum("ok").alias("tasks_complete"), F.sum("bad").alias("tasks_failed"))
    status = F.when(F.col("tasks_failed") > 0, "FAILED").when(F.col("phases_complete") == F.col("phases"), "SUCCESS").otherwise("IN_PROGRESS")
    return out.withColumn("status", status)


def plan_counts(runs: DataFrame) -> DataFrame:
    """Phases per plan, tasks and blocks, from the distinct keys."""
    return runs.groupBy("plan").agg(F.countDistinct("phase").alias("phases"), F.countDistinct("phase", "task").alias("tasks"), F.countDistinct("phase", "task", "block").alias("blocks"))


def last_checkpoint(runs: DataFrame) -> DataFrame:
    """Per plan the task that succeeded last."""
    at = F.struct("completed_at", "task")
    return runs.filter("status = 'SUCCESS'").groupBy("plan").agg(F.max(at).alias("m")).select("plan", "m.task", "m.completed_at")


def success_rate(calls: DataFrame, key: str) -> DataFrame:
    n, ok = F.count("*"), F.count_if("success")
    return calls.groupBy(key).agg(n.alias("uses"), ok.alias("successes"), F.when(n == 0, 0.0).otherwise(ok / n).alias("rate"))


def cache_statistics(entries: DataFrame, now: str, ttl_hours: int) -> DataFrame:
    """Entries (created_at) in all, expired and active at a time."""
    old = F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(ttl_hours)} HOURS")
    return entries.agg(F.count("*").alias("total"), F.count_if(old).alias("expired"), F.count_if(~old).alias("active"))


def least_recently_used(entries: DataFrame, keep: int, used: str, key: str) -> DataFrame:
    """Entries beyond the `keep` most recently used (ties by key): what an eviction deletes.

    The kept keys are a top-k; the rest is an anti join with those k rows.
    """
    kept = entries.select(key, used).orderBy(F.desc(used), F.asc(key)).limit(keep)
    return entries.join(kept.select(key), key, "left_anti")


def retained(calls: DataFrame, now: str, months: int) -> DataFrame:
    """Rows of the current month and of the `months` whole months before it."""
    first = F.add_months(F.trunc(F.lit(now).cast("date"), "month"), -months)
    return calls.filter(F.col("ts") >= first.cast("timestamp"))


def daily_summary(calls: DataFrame) -> DataFrame:
    """Calls, successes and mean ms of each calendar day (UTC session)."""
    return calls.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.avg("duration_ms").alias("mean_ms"))
