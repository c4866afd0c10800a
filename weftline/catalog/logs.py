"""Call-log, run-log and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import runlog as rl
from weftline.operators import tags as tg

_SUMMARY = "count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, count(*) FILTER (cache_hit) AS cache_hits, count(*) FILTER (NOT cache_hit) AS cache_misses, round(100.0::DOUBLE * count(*) FILTER (cache_hit) / count(*), 9) AS hit_rate, count(*) FILTER (script_generated) AS generated, round(avg(duration_ms), 6) AS mean_ms, sum(matches)::BIGINT AS matches, sum(tokens)::BIGINT AS tokens, round(sum(cost), 4) AS cost"


def _rounded(df):
    return df.withColumns({"hit_rate": F.round("hit_rate", 9), "mean_ms": F.round("mean_ms", 6), "cost": F.round("cost", 4)})


@query("calls_summary", f"SELECT {_SUMMARY} FROM calls")
def _(t):
    return _rounded(rl.calls_summary(t.calls))


@query("calls_by_month", f"SELECT strftime(ts, '%Y-%m') AS month, {_SUMMARY} FROM calls GROUP BY 1")
def _(t):
    return _rounded(rl.calls_summary(t.calls.withColumn("month", rl.month_of()), "month"))


@query("src_jsonl_calls", "SELECT call_id, ts FROM calls WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def _(t):
    return rl.calls_between(t.calls, "2024-01-10", "2024-01-20").select("call_id", "ts")


@query("top_patterns", "SELECT pattern, count(*) AS uses FROM calls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return tg.top(t.calls, "pattern", 10)


@query("daily_summary", "SELECT ts::DATE AS day, count(*) AS total, count(*) FILTER (success) AS succeeded, round(avg(duration_ms), 6) AS mean_ms FROM calls GROUP BY 1")
def _(t):
    return rl.daily_summary(t.calls).withColumn("mean_ms", F.round("mean_ms", 6))


@query("retention", "SELECT call_id FROM calls WHERE ts >= TIMESTAMP '2024-01-01'")
def _(t):
    return rl.retained(t.calls, "2024-03-15", 2).select("call_id")


@query("success_rate", "SELECT pattern, count(*) AS uses, count(*) FILTER (success) AS successes, count(*) FILTER (success) / count(*)::DOUBLE AS rate FROM calls GROUP BY 1")
def _(t):
    return rl.success_rate(t.calls, "pattern")


@query("cache_stats", "SELECT count(*) AS total, count(*) FILTER (ts < TIMESTAMP '2024-01-20' - INTERVAL 48 HOURS) AS expired, count(*) FILTER (ts >= TIMESTAMP '2024-01-20' - INTERVAL 48 HOURS) AS active FROM calls")
def _(t):
    return rl.cache_statistics(t.calls.withColumnRenamed("ts", "created_at"), "2024-01-20", 48)


@query("lru_evict", "SELECT o_custkey FROM (SELECT o_custkey, max(o_orderdate) AS used FROM orders GROUP BY 1) QUALIFY row_number() OVER (ORDER BY used DESC, o_custkey) > 100")
def _(t):
    used = t["orders"].groupBy("o_custkey").agg(F.max("o_orderdate").alias("used"))
    return rl.least_recently_used(used, 100, "used", "o_custkey").select("o_custkey")


@query("profile_by_rule", "SELECT rule, count(*) AS executions, round(avg(ms), 6) AS mean_ms, round(sum(ms), 4) AS total_ms, string_agg(DISTINCT phase, ',' ORDER BY phase) AS phases FROM runs GROUP BY 1")
def _(t):
    return rl.profile_by_rule(t.runs).withColumns({"mean_ms": F.round("mean_ms", 6), "total_ms": F.round("total_ms", 4)})


@query("profile_overall", "WITH m AS (SELECT rule, avg(ms) AS mean FROM runs GROUP BY 1) SELECT (SELECT round(avg(ms), 6) FROM runs) AS mean_ms, (SELECT rule FROM m ORDER BY mean DESC, rule LIMIT 1) AS slowest, (SELECT rule FROM m ORDER BY mean, rule LIMIT 1) AS fastest")
def _(t):
    return rl.profile_overall(t.runs).withColumn("mean_ms", F.round("mean_ms", 6))


_REGISTERED = "SELECT DISTINCT rule FROM runs UNION SELECT 'idle_' || r_name FROM region"


def _registered(t):
    return t.runs.select("rule").distinct().union(t["region"].select(F.concat(F.lit("idle_"), "r_name")))


@query("profile_utilisation", f"WITH g AS ({_REGISTERED}) SELECT count(*) AS registered, count(*) FILTER (rule IN (SELECT rule FROM runs)) AS executed, 100.0::DOUBLE * count(*) FILTER (rule IN (SELECT rule FROM runs)) / count(*) AS utilisation FROM g")
def _(t):
    return rl.utilisation(_registered(t), t.runs)


@query("unused_rules", f"WITH g AS ({_REGISTERED}) SELECT rule FROM g WHERE rule NOT IN (SELECT rule FROM runs)")
def _(t):
    return rl.unused_rules(_registered(t), t.runs)


@query("progress_summary", "SELECT rule, count(DISTINCT file) AS files, count(*) AS executions FROM runs GROUP BY 1")
def _(t):
    return rl.progress(t.runs)


@query("progress_totals", "SELECT count(DISTINCT rule) AS rules, count(*) AS executions, count(DISTINCT rule) AS rules_with_files FROM runs")
def _(t):
    return rl.progress_summary(t.runs)


@query("first_trigger", "SELECT rule, seq, file, row_number() OVER (ORDER BY seq, rule) AS place FROM (SELECT rule, seq, file FROM runs QUALIFY row_number() OVER (PARTITION BY rule ORDER BY seq, file) = 1)")
def _(t):
    return rl.first_triggers(t.runs)


@query(
    "plan_progress",
    """WITH t AS (SELECT plan, phase, task, bool_and(status = 'SUCCESS') AS ok, bool_or(status = 'FAILED') AS bad FROM plan_runs GROUP BY 1, 2, 3),
p AS (SELECT plan, phase, count(*) AS tasks, count(*) FILTER (ok) AS ok, count(*) FILTER (bad) AS bad FROM t GROUP BY 1, 2),
s AS (SELECT plan, count(*) AS phases, count(*) FILTER (ok = tasks) AS phases_complete, sum(tasks)::BIGINT AS tasks, sum(ok)::BIGINT AS tasks_complete, sum(bad)::BIGINT AS tasks_failed FROM p GROUP BY 1)
SELECT *, CASE WHEN tasks_failed > 0 THEN 'FAILED' WHEN phases_complete = phases THEN 'SUCCESS' ELSE 'IN_PROGRESS' END AS status FROM s""",
)
def _(t):
    return rl.plan_progress(t.plan_runs)


@query("plan_counts", "SELECT plan, count(DISTINCT phase) AS phases, count(DISTINCT (phase, task)) AS tasks, count(DISTINCT (phase, task, block)) AS blocks FROM plan_runs GROUP BY 1")
def _(t):
    return rl.plan_counts(t.plan_runs)


@query("last_checkpoint", "SELECT plan, task, completed_at FROM plan_runs WHERE status = 'SUCCESS' QUALIFY row_number() OVER (PARTITION BY plan ORDER BY completed_at DESC, task DESC) = 1")
def _(t):
    return rl.last_checkpoint(t.plan_runs)


@query("last_n_history", "SELECT plan, block, row_number() OVER (PARTITION BY plan ORDER BY completed_at DESC, block) AS rank FROM plan_runs QUALIFY rank <= 3")
def _(t):
    return tg.newest(t.plan_runs, ["plan"], "completed_at", 3, "block").select("plan", "block", F.col("rank").cast("long").alias("rank"))


@query("microbatch_flush", "SELECT call_id, ts, pattern, success, matches FROM calls")
def _(t):
    """The whole call log through the streaming flush into monthly folders, read back."""
    from weftline.plans.scratch import Rounds
    from weftline.schema import JSON_TIME
    from weftline.sources.calls import read_calls
    from weftline.streaming.flush import flush_calls

    at = Rounds(t.spark, "flush").path
    t.calls.withColumn("ts", F.col("ts").cast("timestamp")).write.option("timestampFormat", JSON_TIME).json(f"{at}/in")
    flush_calls(t.spark, f"{at}/in", f"{at}/out", f"{at}/state").awaitTermination()
    return read_calls(t.spark, f"{at}/out").select("call_id", "ts", "pattern", "success", "matches")


@query("sink_monthly_jsonl", "SELECT call_id, pattern, success FROM calls WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25 12:00:00'")
def _(t):
    from weftline.plans.scratch import Rounds
    from weftline.sources.calls import read_calls, write_calls

    at = Rounds(t.spark, "monthly").path
    write_calls(t.calls, at)
    return read_calls(t.spark, at, "2024-01-05", "2024-01-25 12:00:00").select("call_id", "pattern", "success")
