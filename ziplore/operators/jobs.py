"""Job analytics over the message log ``job_id, event_id, ts, msg``.

Messages are ordered by ``(ts, event_id)``. Nothing here sorts a whole job:
per-job facts are groupings, and they are joined back to the messages in
slices that follow each job's share of the log, counted in the same grouping, so
a job that dominates the log is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ziplore.functions.messages import CLOSE, is_done, message_body, message_type, stage_of
from ziplore.operators.joins import count_keys, join_measured
from ziplore.operators.ranking import top_per_key

PROGRESS_STEP = 10
PROGRESS_CAP = 100
TIMEOUT_SECONDS = 300


def _at() -> Column:
    return F.struct("ts", "event_id")


def parse_messages(log: DataFrame) -> DataFrame:
    """Add ``type`` and ``body``."""
    return log.withColumns({"type": message_type(F.col("msg")), "body": message_body(F.col("msg"))})


def _closes(log: DataFrame) -> DataFrame:
    """How many messages each job has, ``_n``, and its first ``_close``, in one pass."""
    close = F.when(F.col("msg") == CLOSE, _at())
    return log.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"), F.min(close).alias("_close"))


def events_until_close(log: DataFrame) -> DataFrame:
    """Messages strictly before the first ``close`` of their job."""
    closes = _closes(log)
    closed = closes.filter(F.col("_close").isNotNull()).drop("_n")
    joined = join_measured(log, closed, ["job_id"], "event_id", "left", counts=closes)
    return joined.filter(F.col("_close").isNull() | (_at() < F.col("_close"))).drop("_close")


def job_progress(log: DataFrame) -> DataFrame:
    """Add ``progress``: +10 per event message, at most 100, and 100 once done.

    Progress is full after ten event messages, so the places of a job's first
    ten decide every row; no running sum over the job is needed. Only messages
    before the close are kept.
    """
    steps = PROGRESS_CAP // PROGRESS_STEP
    open_log = events_until_close(log)
    events = open_log.filter(F.col("msg").startswith("event:"))
    first = top_per_key(
        events.select("job_id", "ts", "event_id"),
        ["job_id"], [F.col("ts"), F.col("event_id")], "event_id", steps, out="_n",
    )
    places = first.groupBy("job_id").agg(F.collect_list(_at()).alias("_steps"))
    done = (
        events.filter(is_done(F.col("msg"))).groupBy("job_id").agg(F.min(_at()).alias("_done"))
    )
    facts = places.join(done, "job_id", "left")
    reached = F.size(F.filter("_steps", lambda s: s <= _at())) * PROGRESS_STEP
    progress = (
        F.when(F.col("_done") <= _at(), F.lit(PROGRESS_CAP))
        .when(F.col("_steps").isNull(), F.lit(0))
        .otherwise(F.least(F.lit(PROGRESS_CAP), reached))
    )
    return (
        join_measured(open_log, facts, ["job_id"], "event_id", "left", counts=count_keys(log, ["job_id"]))
        .withColumn("progress", progress)
        .drop("_steps", "_done")
    )


def job_status(log: DataFrame) -> DataFrame:
    """State of each job from its messages before the close.

    An error message makes a job failed and a done event completed; of several
    the last one counts. ``latest_stage`` is the status the last telling event
    stands for.
    """
    open_log = parse_messages(events_until_close(log))
    is_error = F.col("type") == "error"
    outcome = F.when(is_error, F.lit("failed")).when(is_done(F.col("msg")), F.lit("completed"))
    stage = F.when(F.col("type") == "event", stage_of(F.col("body")))
    rows = open_log.select(
        "job_id",
        _at().alias("at"),
        outcome.alias("outcome"),
        F.when(is_error, F.col("body")).alias("error_text"),
        stage.alias("stage"),
    )
    ended = F.when(F.col("outcome").isNotNull(), F.col("at"))
    found = rows.groupBy("job_id").agg(
        F.max_by(F.struct("outcome", "error_text"), ended).alias("_end"),
        F.max_by("stage", F.when(F.col("stage").isNotNull(), F.col("at"))).alias("latest_stage"),
        F.max(ended).alias("_ended"),
    )
    # A job may consist of its close only, so the job list comes from the log.
    jobs = log.groupBy("job_id").agg(F.min("ts").alias("created_at"))
    return jobs.join(found, "job_id", "left").select(
        "job_id",
        F.coalesce("_end.outcome", F.lit("pending")).alias("status"),
        F.col("_end.error_text").alias("error"),
        F.coalesce("latest_stage", F.lit("pending")).alias("latest_stage"),
        "created_at",
        F.col("_ended.ts").alias("completed_at"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1_000_000)


def job_durations(status: DataFrame) -> DataFrame:
    """Seconds from creation to completion, null while a job is open."""
    return status.select(
        "job_id",
        "status",
        F.col("status").isin("completed", "failed").alias("is_complete"),
        seconds_between(F.col("created_at"), F.col("completed_at")).alias("duration_seconds"),
    )


def job_listing(jobs: DataFrame) -> DataFrame:
    """``job_id, status, filename`` of every job with the total on each row.

    The total is a scalar subquery: one count, no window over all jobs.
    """
    total = jobs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return jobs.select("job_id", "status", "filename", total.alias("total"))


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def job_result(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Jobs with their artefact rows; failed jobs carry the error instead."""
    return jobs.join(artifacts, "job_id", "left").withColumn(
        "error", F.when(F.col("status") == "failed", F.col("error"))
    )


# The two sides of the barrier and the counted event.
TREE_EVENT, ANALYSIS_EVENT, FILE_EVENT = "event:TreeBuilt", "event:AnalysisComplete", "event:FileAnalysed"


def first_silences(log: DataFrame, timeout_seconds: int) -> DataFrame:
    """``job_id, silent_from, went_on``: a job's last message before it is silent for more than the timeout.

    Within one stretch of time as long as the timeout no silence is longer, so
    messages are first reduced to the first and the last of each such stretch;
    only these are put in order per job. Where no silence lies between messages
    it is the job's last message, and ``went_on`` is false.
    """
    ms, width = F.unix_millis("ts"), timeout_seconds * 1000
    stretches = log.groupBy("job_id", F.floor(ms / width).alias("_stretch")).agg(F.min(ms).alias("_from"), F.max(ms).alias("_to"))
    in_order = Window.partitionBy("job_id").orderBy("_stretch")
    following = F.lead("_from").over(in_order)
    ends = stretches.withColumn("_next", following).filter(F.col("_next").isNull() | (F.col("_next") - F.col("_to") > width))
    return ends.groupBy("job_id").agg(F.min("_to").alias("silent_from"), (F.min("_to") < F.max("_to")).alias("went_on"))


def job_completion(log: DataFrame, timeout_seconds: int | None = TIMEOUT_SECONDS, now: Column | None = None) -> DataFrame:
    """Jobs whose tree and analysis are both there, and jobs that timed out before: ``job_id, file_count, timed_out``.

    A job times out when it is silent for more than ``timeout_seconds`` before
    it is complete: between two messages, or from its last one to ``now`` (default:
    the latest time in the log). ``file_count`` counts files up to the message
    that completes the job, or up to the silence. Open jobs give no row.
    """
    log = log.select("job_id", "ts", "event_id", "msg")
    said = lambda event: F.min(F.when(F.col("msg") == event, _at()))
    facts = log.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"), said(TREE_EVENT).alias("_tree"), said(ANALYSIS_EVENT).alias("_analysis"))
    both = F.when(F.col("_tree").isNotNull() & F.col("_analysis").isNotNull(), F.greatest("_tree", "_analysis"))
    facts = facts.withColumn("_done", both)
    if timeout_seconds is None:
        ended = facts.filter(F.col("_done").isNotNull()).withColumn("_silent", F.lit(None).cast("long")).withColumn("timed_out", F.lit(False))
    else:
        now = log.agg(F.max("ts")).scalar() if now is None else now
        late = F.col("_done").isNull() | (F.unix_millis("_done.ts") > F.col("silent_from"))
        over = F.col("went_on") | (F.col("silent_from") + timeout_seconds * 1000 < F.unix_millis(now))
        ended = (
            facts.join(first_silences(log, timeout_seconds), "job_id")
            .withColumn("timed_out", late)
            .filter(~late | over)
            .withColumn("_silent", F.when(late, F.col("silent_from")))
        )
    files = log.filter(F.col("msg") == FILE_EVENT)
    joined = join_measured(files, ended.select("job_id", "_done", "_silent"), ["job_id"], "event_id", counts=facts)
    counted = F.when(F.col("_silent").isNotNull(), F.unix_millis("ts") <= F.col("_silent")).otherwise(_at() <= F.col("_done"))
    n_files = joined.filter(counted).groupBy("job_id").agg(F.count(F.lit(1)).alias("_files"))
    return ended.join(n_files, "job_id", "left").select("job_id", F.coalesce("_files", F.lit(0)).alias("file_count"), "timed_out")


def timed_out_jobs(log: DataFrame, timeout_seconds: int = TIMEOUT_SECONDS, now: Column | None = None) -> DataFrame:
    """Jobs that timed out, by the rule of :func:`job_completion`."""
    return job_completion(log, timeout_seconds, now).filter("timed_out").drop("timed_out")
