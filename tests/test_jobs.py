import random
from datetime import datetime, timedelta

from ziplore.operators import jobs

T0 = datetime(2024, 1, 1)
MESSAGES = ["event:NewUpload", "event:FileAnalysed", "event:TreeBuilt", "event:WORKFLOW_DONE", "error:boom: x", "close", "note"]


def random_log(n=800, seed=4):
    rng = random.Random(seed)
    weights = [5, 8, 3, 1, 1, 1, 2]
    rows = []
    for i in range(n):
        job = 0 if rng.random() < 0.35 else rng.randrange(1, 40)
        rows.append((job, i, T0 + timedelta(seconds=rng.randrange(400)), rng.choices(MESSAGES, weights)[0]))
    return rows


def log_frame(spark, rows):
    return spark.createDataFrame(rows, "job_id long, event_id long, ts timestamp, msg string")


def walk(rows):
    """Each job's messages in order, up to its close."""
    per_job = {}
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        per_job.setdefault(row[0], []).append(row)
    return {
        job: found[: next((i for i, r in enumerate(found) if r[3] == "close"), len(found))]
        for job, found in per_job.items()
    }


def test_until_close_and_progress(spark):
    rows = random_log()
    progress = {}
    for found in walk(rows).values():
        bar, done = 0, False
        for r in found:
            bar += 10 * r[3].startswith("event:")
            done = done or r[3] == "event:WORKFLOW_DONE"
            progress[r[1]] = 100 if done else min(100, bar)
    df = log_frame(spark, rows)
    assert {r.event_id for r in jobs.events_until_close(df).collect()} == set(progress)
    assert {r.event_id: r.progress for r in jobs.job_progress(df).collect()} == progress


def test_status_and_durations(spark):
    rows = random_log()
    df = log_frame(spark, rows)
    expected = {}
    created = {}
    for r in rows:
        created[r[0]] = min(created.get(r[0], r[2]), r[2])
    for job, found in walk(rows).items():
        ends = [r for r in found if r[3].startswith("error:") or r[3] == "event:WORKFLOW_DONE"]
        if not ends:
            expected[job] = ("pending", None, None)
        elif ends[-1][3].startswith("error:"):
            expected[job] = ("failed", "boom: x", ends[-1][2])
        else:
            expected[job] = ("completed", None, ends[-1][2])
    status = jobs.job_status(df)
    assert {r.job_id: (r.status, r.error, r.completed_at) for r in status.collect()} == expected
    for r in jobs.job_durations(status).collect():
        end = expected[r.job_id][2]
        assert r.is_complete == (end is not None)
        assert r.duration_seconds == (None if end is None else (end - created[r.job_id]).total_seconds())


def test_listing_and_result(spark):
    rows = [
        (1, 0, T0, "event:ANALYSIS_STARTED"), (1, 1, T0 + timedelta(seconds=10), "event:ANALYSIS_COMPLETED"),
        (2, 2, T0, "event:ANALYSIS_STARTED"), (2, 3, T0 + timedelta(seconds=400), "error:slow"),
        (3, 4, T0 + timedelta(seconds=50), "event:ZipValid"), (4, 5, T0 + timedelta(seconds=395), "event:NewUpload"),
        (5, 6, T0, "close"),
    ]
    status = jobs.job_status(log_frame(spark, rows))
    found = {r.job_id: (r.status, r.latest_stage) for r in status.collect()}
    assert found == {1: ("completed", "completed"), 2: ("failed", "validating"), 3: ("pending", "extracting"),
                     4: ("pending", "validating"), 5: ("pending", "pending")}
    from pyspark.sql import functions as F

    listing = jobs.job_listing(status.withColumn("filename", F.lit("x.zip"))).collect()
    assert len(listing) == 5 and {r.total for r in listing} == {5}
    assert {r.status: r.n for r in jobs.job_counts(status).collect()} == {"completed": 1, "failed": 1, "pending": 3}
    artifacts = spark.createDataFrame([(1, "text")], "job_id long, project_summary string")
    result = {r.job_id: (r.project_summary, r.error) for r in jobs.job_result(status, artifacts).collect()}
    assert result[1] == ("text", None) and result[2] == (None, "slow")


def completed(rows, timeout, now):
    """Jobs taken message by message."""
    per_job, out = {}, {}
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        per_job.setdefault(row[0], []).append(row)
    for job, found in per_job.items():
        seen, files, last = set(), 0, None
        for _, _, ts, msg in found:
            if timeout is not None and last is not None and (ts - last).total_seconds() > timeout:
                out[job] = (files, True)
                break
            seen.add(msg)
            files += msg == jobs.FILE_EVENT
            last = ts
            if {jobs.TREE_EVENT, jobs.ANALYSIS_EVENT} <= seen:
                out[job] = (files, False)
                break
        else:
            if timeout is not None and (now - last).total_seconds() > timeout:
                out[job] = (files, True)
    return out


def completion_log(n=900, seed=5):
    rng = random.Random(seed)
    kinds = ["event:FileAnalysed", "event:TreeBuilt", "event:AnalysisComplete", "note", "close"]
    rows = []
    for i in range(n):
        job = 0 if rng.random() < 0.3 else rng.randrange(1, 60)
        rows.append((job, i, T0 + timedelta(milliseconds=rng.randrange(0, 4_000_000, 250)), rng.choices(kinds, [8, 1, 1, 4, 1])[0]))
    return rows


def test_completion_and_timeouts_by_one_rule(spark):
    rows = completion_log()
    df = log_frame(spark, rows)
    now = max(r[2] for r in rows)
    for timeout in (None, 20, 300, 900, 10_000):
        got = {r.job_id: (r.file_count, r.timed_out) for r in jobs.job_completion(df, timeout).collect()}
        assert got == completed(rows, timeout, now)
    from pyspark.sql import functions as F

    early = now - timedelta(seconds=600)
    got = {r.job_id: (r.file_count, r.timed_out) for r in jobs.job_completion(df, 300, F.lit(early)).collect()}
    assert got == completed(rows, 300, early)
    assert {r.job_id for r in jobs.timed_out_jobs(df, 300).collect()} == {j for j, (_, late) in completed(rows, 300, now).items() if late}
    assert jobs.job_completion(df.limit(0)).count() == 0
