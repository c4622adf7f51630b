"""Continuous forms: archives in, per-file results, counts, jobs, artefacts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ziplore.functions.messages import CLOSE
from ziplore.operators.jobs import ANALYSIS_EVENT, FILE_EVENT, TIMEOUT_SECONDS, TREE_EVENT
from ziplore.operators.joins import join_measured
from ziplore.operators.triage import analysable
from ziplore.plans.corpus import analyze_archives, describe_files, upload_verdicts
from ziplore.session import configure, pin
from ziplore.sources.archives import MAX_MEMBER_MB, explode_members
from ziplore.streaming.tables import KeyedTable


def _parse(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def stream_file_results(
    archives: DataFrame, max_member_mb: float = MAX_MEMBER_MB, analyzers: dict | None = None
) -> DataFrame:
    """Per-file results as archives arrive. Stateless, append mode.

    Guards and de-duplication run per archive inside the unpacking step, which
    sees all members of an archive at once.
    """
    return analysable(describe_files(explode_members(archives, max_member_mb), analyzers))


def stream_project_counts(results: DataFrame) -> DataFrame:
    """Running file counts per project and kind. Update mode; Spark keeps the counts for as long as the query lives."""
    return results.groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("n"))


PROJECT_COUNTS = "project_id string, kind string, n long, last_batch long"


def project_counts_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, _parse(PROJECT_COUNTS), ["project_id", "kind"], {"n": F.sum, "last_batch": F.max})


def write_project_counts(results: DataFrame, path: str, checkpoint: str, idle_batches: int | None = None):
    """Keep running file counts per project and kind in a table (:class:`KeyedTable`).

    The query itself holds no state: each micro-batch is counted and added to
    the buckets it touches. Counts that nothing was added to for ``idle_batches``
    batches are dropped when their bucket is next written.
    """
    table = project_counts_table(results.sparkSession, path)

    def save(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("last_batch", F.lit(batch_id))
        keep = None if idle_batches is None else F.col("last_batch") >= batch_id - idle_batches
        table.upsert(counts, batch_id, keep)

    return results.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


# --- job completion -------------------------------------------------------

_SIGNALS = {TREE_EVENT: 1, ANALYSIS_EVENT: 2, FILE_EVENT: 3}
_COMPLETION = "job_id long, file_count long, timed_out boolean"

# How long a job is remembered as done or closed, so that late messages do not
# open it again.
RETENTION_SECONDS = 7 * 86_400

# Time modes of the state, by the clock that expires it. Event time drops
# messages older than the watermark; the clock of the running query (the
# default; such a query never ends by itself) drops none.
CLOCKS = {"event": "EventTime", "processing": "ProcessingTime"}


class _Completion(StatefulProcessor):
    """Waits for a job's tree and analysis; see :func:`stream_job_completion`."""

    def __init__(self, timeout_seconds: int | None, clock: str, retention_seconds: int):
        self.timeout_ms = None if timeout_seconds is None else timeout_seconds * 1000
        self.by_event, self.retention_ms = clock == "event", retention_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "tree boolean, analysis boolean, files long, last_ms long, done boolean")

    def close(self) -> None:
        pass

    def _wake(self, timers, last_ms: int, after_ms: int) -> None:
        """One timer per job: a given time after its last message, or from now on."""
        if self.timeout_ms is None:
            return
        for known in list(self.handle.listTimers()):
            self.handle.deleteTimer(known)
        now = timers.getCurrentWatermarkInMs() if self.by_event else timers.getCurrentProcessingTimeInMs()
        due = last_ms + after_ms + 1
        self.handle.registerTimer(max(due, now + 1) if self.by_event else now + after_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tree, analysis, files, last_ms, done = self.job.get() or (False, False, 0, None, False)
        if done:
            return
        # Numbers only: when, which message, and what kind it is.
        held = [b[["ts_us", "event_id", "signal"]].to_numpy("int64") for b in rows]
        at = np.concatenate(held)
        at = at[np.lexsort((at[:, 1], at[:, 0]))]
        ms, signal = at[:, 0] // 1000, at[:, 2]
        n = len(at)
        first = lambda marked: int(np.argmax(marked)) if marked.any() else n
        complete = max(-1 if tree else first(signal == 1), -1 if analysis else first(signal == 2))
        quiet = n
        if self.timeout_ms is not None and self.by_event:
            gaps = np.diff(ms, prepend=ms[:1] if last_ms is None else [last_ms])
            quiet = first(gaps > self.timeout_ms)
        end = min(complete + 1, quiet)
        files += int((signal[:end] == 3).sum())
        done = min(complete, quiet) < n
        if end:
            last_ms = int(ms[end - 1]) if last_ms is None else max(int(ms[end - 1]), last_ms)
        self.job.update((tree or bool((signal == 1).any()), analysis or bool((signal == 2).any()), files, last_ms, done))
        self._wake(timerValues, last_ms, self.retention_ms if done else self.timeout_ms or 0)
        if done:
            yield pd.DataFrame({"job_id": [key[0]], "file_count": [files], "timed_out": [quiet <= complete]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.job.get()
        if known is None:
            return
        tree, analysis, files, last_ms, done = known
        if done:
            self.job.clear()
            return
        self.job.update((tree, analysis, files, last_ms, True))
        self._wake(timerValues, last_ms, self.retention_ms)
        yield pd.DataFrame({"job_id": [key[0]], "file_count": [files], "timed_out": [True]})


def stream_job_completion(
    events: DataFrame,
    timeout_seconds: int | None = TIMEOUT_SECONDS,
    clock: str = "processing",
    delay: str = "10 minutes",
    retention_seconds: int = RETENTION_SECONDS,
) -> DataFrame:
    """One row per job once its tree and its analysis are both there.

    The stream form of :func:`ziplore.operators.jobs.job_completion`: messages
    are taken in order of ``(ts, event_id)``, ``file_count`` counts the files up to
    the message that completes the job, and a job that is silent for more than
    ``timeout_seconds`` before that is given out with ``timed_out`` set, whether the
    next message comes in the same micro-batch, a later one or never. So the
    result does not depend on how messages in order are cut into micro-batches.
    Either way the job is then only remembered as done, for
    ``retention_seconds``, and later messages give nothing. With
    ``timeout_seconds`` None jobs wait, and are remembered, for ever. By the clock
    of the running query silence is only what that clock measures.

    Jobs are kept in the state store on disk with a timer each.
    """
    signal = F.lit(0)
    for msg, number in _SIGNALS.items():
        signal = F.when(F.col("msg") == msg, number).otherwise(signal)
    rows = events
    if timeout_seconds is not None and clock == "event":
        rows = rows.withWatermark("ts", delay)
    elif timeout_seconds is None:
        # Nothing but signals matters when no silence is measured.
        rows = rows.filter(signal > 0)
    rows = rows.select("job_id", "ts", F.unix_micros("ts").alias("ts_us"), "event_id", signal.cast("long").alias("signal"))
    mode = "None" if timeout_seconds is None else CLOCKS[clock]
    return rows.groupBy("job_id").transformWithStateInPandas(
        _Completion(timeout_seconds, clock, retention_seconds), _COMPLETION, "append", mode
    )


# --- messages until close -------------------------------------------------

CLOSES = "job_id long, closed_at timestamp, closed_by long"


def closes_table(spark: SparkSession, path: str) -> KeyedTable:
    """The first close of each job."""
    return KeyedTable(spark, path, _parse(CLOSES), ["job_id"], {"closed_at": F.min, "closed_by": F.min})


def write_job_messages(
    events: DataFrame, out: str, closes: str, checkpoint: str, retention_seconds: int | None = RETENTION_SECONDS
):
    """Forward the messages of a job until its first ``close`` to ``out``, a folder per micro-batch.

    Micro-batches must arrive in order. A batch's first close per job is a small
    grouping; together with the closes of earlier batches (:class:`KeyedTable` at
    ``closes``) it is joined to the messages, which are then filtered row by row
    without leaving the JVM; busy jobs are cut by their share of the batch. A
    close is forgotten once the batch's latest message is ``retention_seconds``
    past it. A batch that is run again gives the same folder.
    """
    table = closes_table(events.sparkSession, closes)

    def forward(batch: DataFrame, batch_id: int) -> None:
        rows = pin(batch.select("job_id", "event_id", "ts", "msg"))
        _, earlier = table.before(batch_id)
        at = F.struct("ts", "event_id")
        found = rows.groupBy("job_id").agg(
            F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("msg") == CLOSE, at)).alias("_close")
        )
        found = pin(found)
        closed = found.filter(F.col("_close").isNotNull()).select("job_id", F.col("_close.ts").alias("closed_at"), F.col("_close.event_id").alias("closed_by"))
        # A job that was closed before stays closed, whatever its later messages say.
        shut = earlier.select("job_id", F.lit(True).alias("_shut"))
        facts = found.join(shut, "job_id", "left").filter(F.col("_close").isNotNull() | F.col("_shut")).select("job_id", "_close", "_shut")
        joined = join_measured(rows, facts, ["job_id"], "event_id", "left", counts=found)
        open_ = F.col("_shut").isNull() & (F.col("_close").isNull() | (at < F.col("_close")))
        joined.filter(open_).select("job_id", "event_id", "ts", "msg").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        keep = None
        if retention_seconds is not None:
            latest = rows.agg(F.max("ts")).first()[0]
            keep = None if latest is None else F.col("closed_at") >= F.lit(latest) - F.expr(f"INTERVAL {retention_seconds} SECONDS")
        table.upsert(closed, batch_id, keep)

    return events.writeStream.foreachBatch(forward).option("checkpointLocation", checkpoint)


# --- end to end -----------------------------------------------------------


def stream_artifacts(archives: DataFrame, out: str, checkpoint: str, by_range: bool = True, **options):
    """Append the artefacts of each new archive below ``out``.

    All members of an archive are in one micro-batch, so the batch plan applies
    as it is. With ``by_range`` the stream carries paths only and each archive is
    read by ranges; without it, for stores that tasks can't open on their own,
    Spark's source reads whole archives. Each batch owns one folder and overwrites
    it when it is retried. Returns a stream writer that is ready to start.
    """
    if by_range:
        archives = archives.select("project_id", "path")

    def analyse(batch: DataFrame, batch_id: int) -> None:
        artifacts = analyze_archives(batch, **options)
        artifacts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return archives.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint)


def write_upload_verdicts(uploads: DataFrame, out: str, checkpoint: str, **limits):
    """Write a verdict on each upload of :func:`ziplore.sources.uploads.stream_uploads` below ``out``, a folder per micro-batch.

    The stream form of ``corpus_verdicts``, whose limits it takes.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        verdicts = upload_verdicts(pin(batch.select("path", "project_id", "length")), **limits)
        verdicts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return uploads.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)


def write_updates(df: DataFrame, out: str, checkpoint: str, mode: str = "update"):
    """Write each micro-batch to its own folder; safe to retry."""
    configure(df.sparkSession)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint)
    )


def drain(writer) -> None:
    """Run a stream over everything that is there and stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
