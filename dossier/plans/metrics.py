"""Queries on the run log: queue depth, stage statistics, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier import views
from dossier.streaming import runs as streaming
from dossier.view_sql import with_views


def _recent(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of the last 24 hours of the log."""
    log = views.runs(spark, folder)
    last = log.agg(F.max("at").alias("last"))
    return log.join(F.broadcast(last)).where(F.col("at") >= F.col("last") - F.expr("interval 24 hours"))


def queue_depth(spark: SparkSession, folder: str) -> DataFrame:
    return views.runs(spark, folder).groupBy("status").agg(F.count("*").alias("n"))


def stage_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _recent(spark, folder).groupBy("stage", "status").agg(F.count("*").alias("runs"), F.round(F.avg("duration_ms"), 1).alias("mean_ms"))


def stage_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Successes and failures side by side."""
    return views.runs(spark, folder).groupBy("stage").pivot("status", ["success", "failure"]).count().na.fill(0)


def oldest_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Age of the oldest pending run at the end of the log, in seconds; NULL without one."""
    log = views.runs(spark, folder)
    oldest = F.min(F.when(F.col("status") == "pending", F.col("at")))
    return log.agg(((F.unix_micros(F.max("at")) - F.unix_micros(oldest)) / 1e6).alias("seconds"))


def retries(spark: SparkSession, folder: str) -> DataFrame:
    return _recent(spark, folder).agg(F.count_if(F.col("attempt") > 1).alias("retries"))


def retry_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """When each failed run is due again: 30 seconds, doubled by every attempt."""
    failed = views.runs(spark, folder).where("status = 'failure'")
    return failed.select("run_id", (F.unix_micros("at") + (30_000_000 * F.pow(F.lit(2), F.col("attempt"))).cast("long")).alias("due_us"))


def latest_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most recent runs of every stage."""
    log = views.runs(spark, folder)
    place = F.row_number().over(W.partitionBy("stage").orderBy(F.desc("at"), F.desc("run_id"))).cast("long")
    return log.withColumn("place", place).where("place <= 10").select("stage", "place", "run_id", "status")


def stage_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Runs per stage and hour."""
    return streaming.hourly(views.runs(spark, folder)).select("stage", F.unix_micros("window.start").alias("start_us"), "runs", "failures")


def stream_stage_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a stream over the events table, run until it is used up."""
    return streaming.hourly_stream(spark, folder).select("stage", F.unix_micros("window.start").alias("start_us"), "runs", "failures")


def run_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a document that follow within 30 minutes of each other."""
    log = views.runs(spark, folder)
    grouped = log.groupBy("document", F.session_window("at", "30 minutes").alias("s")).agg(F.count("*").alias("runs"))
    return grouped.select("document", F.unix_micros("s.start").alias("start_us"), "runs")


QUERIES = {f.__name__: f for f in (queue_depth, stage_stats, stage_pivot, oldest_pending, retries, retry_backoff, latest_runs, stage_windows, stream_stage_windows, run_sessions)}

_HOURS = """select stage, epoch_us(date_trunc('hour', moment)) start_us, count(*) runs, count(*) filter (status = 'failure') failures from run group by 1, 2"""
SQL = {
    "queue_depth": with_views("run", "select status, count(*) n from run group by 1"),
    "stage_stats": with_views("run", "select stage, status, count(*) runs, round(avg(duration_ms), 1) mean_ms from run where moment >= (select max(moment) from run) - interval 24 hours group by 1, 2"),
    "stage_pivot": with_views("run", "select stage, count(*) filter (status = 'success') success, count(*) filter (status = 'failure') failure from run group by 1"),
    "oldest_pending": with_views("run", "select (epoch_us(max(moment)) - epoch_us(min(moment) filter (status = 'pending'))) / 1e6 as \"seconds\" from run"),
    "retries": with_views("run", "select count(*) filter (attempt > 1) retries from run where moment >= (select max(moment) from run) - interval 24 hours"),
    "retry_backoff": with_views("run", "select run_id, epoch_us(moment) + cast(30000000 * pow(2, attempt) as bigint) due_us from run where status = 'failure'"),
    "latest_runs": with_views("run", "select stage, row_number() over (partition by stage order by moment desc, run_id desc) place, run_id, status from run qualify place <= 10"),
    "stage_windows": with_views("run", _HOURS),
    "stream_stage_windows": with_views("run", _HOURS),
    "run_sessions": with_views("run", """, gaps as (select *, case when moment - lag(moment) over w < interval 30 minutes then 0 else 1 end new from run window w as (partition by document order by moment, run_id)),
numbered as (select *, sum(new) over (partition by document order by moment, run_id) s from gaps)
select document, epoch_us(min(moment)) start_us, count(*) runs from numbered group by document, s"""),
}
