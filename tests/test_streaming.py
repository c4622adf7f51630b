import time
from datetime import datetime, timedelta

import pytest

from tests.test_archives import CASES, SAMPLE, make_zip
from tests.test_jobs import completed, completion_log
from ziplore.sources import archives
from ziplore.streaming import streams

T0 = datetime(2024, 1, 1)
MESSAGES = "job_id long, event_id long, ts timestamp, msg string"


class Feed:
    """A folder stream that takes one file per micro-batch."""

    def __init__(self, spark, home):
        self.spark, self.home, self.out = spark, str(home / "in"), str(home / "out")
        self.progress, self.n = str(home / "progress"), 0
        (home / "in").mkdir()

    def add(self, *rows):
        df = self.spark.createDataFrame(list(rows), MESSAGES)
        df.coalesce(1).write.mode("append").parquet(f"{self.home}/{self.n}")
        self.n += 1

    def run(self, operator, **options):
        source = self.spark.readStream.schema(MESSAGES).parquet(f"{self.home}/*")
        out = operator(source, **options)
        streams.drain(streams.write_updates(out, self.out, self.progress, "append"))
        return self.spark.read.schema(out.schema).parquet(f"{self.out}/batch=*").collect()


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_completion_waits_for_both_sides(feed):
    done = lambda rows: sorted((r.job_id, r.file_count, r.timed_out) for r in rows)
    options = {"timeout_seconds": None}
    feed.add((1, 0, at(0), "event:FileAnalysed"), (1, 1, at(1), "event:TreeBuilt"), (2, 2, at(1), "event:TreeBuilt"))
    assert done(feed.run(streams.stream_job_completion, **options)) == []
    feed.add((1, 3, at(2), "event:FileAnalysed"), (1, 4, at(3), "event:AnalysisComplete"), (3, 5, at(3), "note"))
    assert done(feed.run(streams.stream_job_completion, **options)) == [(1, 2, False)]
    feed.add((2, 6, at(9), "event:AnalysisComplete"))
    assert done(feed.run(streams.stream_job_completion, **options)) == [(1, 2, False), (2, 0, False)]


def test_completion_expires_by_event_time(feed):
    options = {"timeout_seconds": 60, "clock": "event", "delay": "0 seconds"}
    feed.add((1, 0, at(0), "event:TreeBuilt"), (1, 1, at(1), "event:FileAnalysed"))
    feed.run(streams.stream_job_completion, **options)
    feed.add((2, 2, at(500), "event:TreeBuilt"), (2, 3, at(501), "event:AnalysisComplete"))
    rows = feed.run(streams.stream_job_completion, **options)
    assert sorted((r.job_id, r.file_count, r.timed_out) for r in rows) == [(1, 1, True), (2, 0, False)]


def test_one_answer_per_job_whatever_comes_late(feed):
    options = {"timeout_seconds": 60, "clock": "event", "delay": "0 seconds"}
    run = lambda: sorted((r.job_id, r.file_count, r.timed_out) for r in feed.run(streams.stream_job_completion, **options))
    feed.add((1, 0, at(0), "event:TreeBuilt"), (1, 1, at(1), "event:AnalysisComplete"))
    assert run() == [(1, 0, False)]
    feed.add((1, 2, at(20), "event:FileAnalysed"), (3, 3, at(20), "event:TreeBuilt"))
    run()
    feed.add((2, 4, at(500), "event:TreeBuilt"))
    run()
    feed.add((3, 5, at(510), "event:AnalysisComplete"), (2, 6, at(520), "event:AnalysisComplete"))
    assert run() == [(1, 0, False), (2, 0, False), (3, 0, True)]


@pytest.mark.parametrize("cuts", [1, 3, 8])
@pytest.mark.parametrize("timeout", [None, 300])
def test_completion_does_not_depend_on_the_cut(feed, cuts, timeout):
    """Equal to the batch rule, however messages in order are cut into micro-batches, with expiry on."""
    rows = sorted(completion_log(), key=lambda r: (r[2], r[1]))
    options = {"timeout_seconds": timeout, "clock": "event", "delay": "0 seconds"}
    size = -(-len(rows) // cuts)
    for k in range(cuts):
        feed.add(*rows[k * size : (k + 1) * size])
        got = feed.run(streams.stream_job_completion, **options)
    # One row per job, and none for jobs that are still open.
    assert len(got) == len({r.job_id for r in got})
    assert {r.job_id: (r.file_count, r.timed_out) for r in got} == completed(rows, timeout, rows[-1][2])


class MessageFeed(Feed):
    def run(self, **options):
        source = self.spark.readStream.schema(MESSAGES).parquet(f"{self.home}/*")
        streams.drain(streams.write_job_messages(source, self.out, f"{self.out}-closes", self.progress, **options))
        return sorted(r.event_id for r in self.spark.read.schema(MESSAGES).parquet(f"{self.out}/batch=*").collect())


def test_messages_stop_at_close(spark, tmp_path):
    feed = MessageFeed(spark, tmp_path)
    feed.add((1, 0, at(0), "event:a"), (1, 9, at(2), "event:late"), (1, 1, at(1), "close"), (2, 2, at(0), "event:b"), (3, 3, at(0), "close"))
    assert feed.run() == [0, 2]
    feed.add((1, 20, at(5), "event:after"), (2, 21, at(6), "event:c"), (2, 22, at(7), "close"), (2, 23, at(7), "event:tie"), (3, 24, at(8), "close"))
    assert feed.run() == [0, 2, 21]
    feed.add((2, 30, at(9), "event:d"), (4, 31, at(9), "event:e"), (3, 32, at(10), "event:f"))
    assert feed.run() == [0, 2, 21, 31]


def test_closes_are_forgotten_after_a_while(spark, tmp_path):
    feed = MessageFeed(spark, tmp_path)
    feed.add((1, 0, at(0), "close"), (2, 1, at(90), "close"))
    assert feed.run(retention_seconds=60) == []
    feed.add((1, 2, at(100), "event:a"), (1, 3, at(101), "close"), (2, 4, at(102), "event:b"))
    assert feed.run(retention_seconds=60) == [2]  # job 2 closed 12 seconds ago, job 1 long ago


def test_messages_until_close_over_several_batches(spark, tmp_path):
    from ziplore.operators import jobs

    rows = sorted(completion_log(), key=lambda r: (r[2], r[1]))
    feed = MessageFeed(spark, tmp_path)
    for k in range(5):
        feed.add(*rows[k * 180 : (k + 1) * 180])
        got = feed.run(retention_seconds=None)
    df = spark.createDataFrame(rows, MESSAGES)
    assert got == sorted(r.event_id for r in jobs.events_until_close(df).collect())


def test_a_keyed_table_is_whole_at_every_version(spark, tmp_path):
    """Totals over batches, a batch that runs again, and versions that go."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    from ziplore.streaming.tables import KeyedTable

    table = KeyedTable(spark, f"{tmp_path}/t", StructType.fromDDL("k long, n long, latest long"), ["k"], {"n": F.sum, "latest": F.max}, buckets=4)
    assert table.read().count() == 0
    want = {}
    for batch in range(6):
        rows = [(k % (7 + batch), k, batch) for k in range(30)] if batch != 3 else []
        df = spark.createDataFrame(rows, "k long, n long, latest long")
        for _ in range(2):  # the second time is a retry
            table.upsert(df, batch)
        for k, n, latest in rows:
            old = want.get(k, (0, 0))
            want[k] = (old[0] + n, latest)
        assert {r.k: (r.n, r.latest) for r in table.read().collect()} == want
    kept = sorted(p.name for p in (tmp_path / "t").glob("version=*/bucket=*"))
    assert len(kept) <= 8
    table.upsert(spark.createDataFrame([(1, 1, 9)], "k long, n long, latest long"), 9, F.col("latest") >= 5)
    left = {r.k for r in table.read().collect()}
    assert 1 in left


def test_archives_are_analysed_once(spark, tmp_path):
    home = tmp_path / "in"
    home.mkdir()
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        streams.drain(streams.stream_artifacts(archives.stream_archives(spark, str(home)), out, progress))
        return sorted(r.project_id for r in spark.read.parquet(out).collect())

    (home / "first.zip").write_bytes(make_zip(*SAMPLE))
    (home / "bad.zip").write_bytes(CASES["crc"])
    assert run() == ["first"]
    (home / "second.ZIP").write_bytes(make_zip(*SAMPLE))
    assert run() == ["first", "second"]
    assert run() == ["first", "second"]


def test_each_upload_has_one_verdict(spark, tmp_path):
    """Also zero bytes, hidden names and faults; once per time it is written; equal to the batch verdicts."""
    from ziplore.plans.corpus import corpus_verdicts
    from ziplore.sources import uploads

    home, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    (home / "u1").mkdir(parents=True)
    (home / "u2").mkdir()

    def run():
        arriving = uploads.stream_uploads(spark, f"{home}/*")
        streams.drain(streams.write_upload_verdicts(arriving, out, progress, max_archive_mb=0.01))
        schema = "project_id string, path string, length long, reason string"
        return sorted((r.project_id, r.length, r.reason or "") for r in spark.read.schema(schema).parquet(f"{out}/batch=*").collect())

    def written(name, blob):
        (home / name).write_bytes(blob)
        time.sleep(0.01)

    for name, blob in (("u1/good.zip", CASES["good"]), ("u1/_hidden.zip", CASES["good"]), ("u2/good.ZIP", b""), ("u2/note.txt", b"x")):
        written(name, blob)
    first = run()
    assert [r[0] for r in first] == ["u1/_hidden", "u1/good", "u2/good"]
    assert run() == first
    for name, blob in (("u2/crc.zip", CASES["crc"]), ("u2/.dot.zip", b"zz"), ("u1/huge.zip", b"0" * 20_000), ("u2/slip.zip", CASES["slip"])):
        written(name, blob)
    want = sorted((r.project_id, r.length, r.reason or "") for r in corpus_verdicts(spark, f"{home}/*", max_archive_mb=0.01).collect())
    assert run() == want and len(want) == 7
    written("u2/good.ZIP", CASES["good"])
    again = run()
    assert len(again) == 8 and ("u2/good", len(CASES["good"]), "") in again


def test_running_counts(spark, tmp_path):
    home = tmp_path / "in"
    home.mkdir()
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        results = streams.stream_file_results(archives.stream_archives(spark, str(home)))
        streams.drain(streams.write_project_counts(results, out, progress))
        return {(r.project_id, r.kind): r.n for r in streams.project_counts_table(spark, out).read().collect()}

    (home / "a.zip").write_bytes(make_zip(*SAMPLE))
    assert run() == {("a", "text"): 1, ("a", "python"): 1, ("a", "json"): 1}
    # The same project again, from another folder level.
    (home / "b.zip").write_bytes(make_zip(("x.md", "x"), ("y.md", "y")))
    assert run()[("b", "text")] == 2
