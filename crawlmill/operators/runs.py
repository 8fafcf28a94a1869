"""Run logs of scheduled jobs: status, totals and recent runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cron import interval_seconds

KEPT_RUNS = 10


def job_intervals(jobs: DataFrame) -> DataFrame:
    """Jobs with the seconds between runs: a readable cron text wins over ``interval_seconds``."""
    from_cron = interval_seconds("cron")
    return jobs.withColumns(
        {
            "cron_applied": from_cron.isNotNull(),
            "interval_seconds": F.coalesce(from_cron, F.col("interval_seconds").cast("bigint")),
        }
    )


def job_status(runs: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Roll-up per job: successful and failed runs, last success, last error, last result.

    ``runs`` has ``job, ts, seq, success, result, error``. With ``jobs`` (name, interval_seconds) jobs
    that never ran are listed too and ``next_run`` is the last attempt plus the interval.
    """
    at = F.struct("ts", "seq")
    won, lost = F.col("success"), ~F.col("success")
    status = runs.groupBy("job").agg(
        F.count_if(won).alias("run_count"),
        F.count_if(lost).alias("error_count"),
        F.max(F.when(won, F.col("ts"))).alias("last_run"),
        F.max_by(F.when(lost, F.col("error")), F.when(lost, at)).alias("last_error"),
        F.max_by(F.when(won, F.col("result")), F.when(won, at)).alias("last_result"),
        F.max("ts").alias("last_attempt"),
    )
    if jobs is None:
        return status
    listed = jobs.select(F.col("name").alias("job"), "interval_seconds").join(status, "job", "left")
    zero = F.lit(0).cast("bigint")
    return listed.withColumns(
        {
            "run_count": F.coalesce("run_count", zero),
            "error_count": F.coalesce("error_count", zero),
            "next_run": F.col("last_attempt") + F.make_dt_interval(secs=F.col("interval_seconds").cast("decimal(18,6)")),
        }
    ).drop("interval_seconds")


def fleet_totals(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: jobs, enabled jobs, successful runs and errors of known jobs."""
    status = runs.groupBy("job").agg(
        F.count_if(F.col("success")).alias("run_count"), F.count_if(~F.col("success")).alias("error_count")
    )
    return jobs.join(status, F.col("name") == F.col("job"), "left").agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(F.col("enabled")).alias("active_jobs"),
        F.coalesce(F.sum("run_count"), F.lit(0)).alias("total_runs"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("total_errors"),
    )


def recent_runs(runs: DataFrame, limit: int = KEPT_RUNS) -> DataFrame:
    """The newest ``limit`` runs of each job, newest first (ten unless asked for more).

    The rank filter is applied per task before the shuffle, so a very busy job sends few rows.
    """
    newest = W.partitionBy("job").orderBy(F.col("ts").desc(), F.col("seq").desc())
    return runs.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= limit)
