"""Archives read by ranges, and folders listed by tasks."""

import os
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from checks import corpus
from tests.test_archives import CASES, REASONS, flipped, make_zip
from ziplore import analyze_corpus
from ziplore.operators import validate
from ziplore.sources import archives, folders, ranges

LIMIT = 2048 / archives.MB


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    home = tmp_path_factory.mktemp("uploads")
    for name, blob in CASES.items():
        (home / f"{name}.zip").write_bytes(blob)
    return str(home)


def listed(spark, folder):
    return archives.list_archives(spark, folder).select("project_id", "path")


@pytest.mark.parametrize("range_bytes", [1, 64, ranges.RANGE_BYTES])
def test_equals_whole_archives(spark, folder, range_bytes):
    """Ranges of one member, of a few, of all: the same rows as from archives that are rows."""
    whole = spark.createDataFrame([c for c in CASES.items() if c[1]], "project_id string, content binary")
    want = {tuple(r) for r in archives.open_archives(whole, LIMIT).collect()}
    assert {tuple(r) for r in ranges.open_by_range(listed(spark, folder), LIMIT, range_bytes=range_bytes).collect()} == want
    faults = {r.project_id: r.reject_reason for r in ranges.range_faults(listed(spark, folder), LIMIT, range_bytes).collect()}
    assert faults == {name: REASONS.get(name) for name in CASES if name != "nothing"}


def test_first_fault_by_member_is_named(spark, tmp_path):
    blob = make_zip(("a", b"1" * 50), ("b", b"2" * 50), ("c", b"3" * 50))
    bad = flipped(flipped(blob, blob.index(b"2" * 50)), blob.index(b"3" * 50))
    (tmp_path / "x.zip").write_bytes(bad)
    (tmp_path / "gone.zip").write_bytes(blob)
    (tmp_path / "cut.zip").write_bytes(blob[:-30])
    found = listed(spark, str(tmp_path)).unionByName(spark.createDataFrame([("lost", f"file:{tmp_path}/lost.zip")], "project_id string, path string"))
    plan = ranges.plan_ranges(found, LIMIT, range_bytes=1)
    (tmp_path / "gone.zip").unlink()  # after it was planned
    got = {r.project_id: r.reject_reason for r in ranges.first_faults(ranges.read_ranges(plan, LIMIT, range_bytes=1)).collect()}
    assert got["x"] == "CRC error in member: b" and got["cut"] == "Not a ZIP archive"
    assert got["gone"].startswith("Unreadable archive") and got["lost"].startswith("Unreadable archive")


def test_oversized_members_are_not_unpacked(spark, tmp_path):
    """What the directory declares is answered without reading a member."""
    blob = make_zip(("ok", b"x" * 100), ("big", b"0" * 5000))
    (tmp_path / "a.zip").write_bytes(flipped(blob, blob.index(b"x" * 100)))
    (row,) = ranges.range_faults(listed(spark, str(tmp_path)), LIMIT).collect()
    assert row.reject_reason == f"Member big exceeds {LIMIT:g} MB"


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        for i in range(64):
            z.writestr(f"f{i}.txt", os.urandom(40_000))
    rows = ranges.explode_by_range(listed(spark, str(tmp_path)), range_bytes=160_000)
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(t.n for t in tasks) == 64
    assert len(tasks) >= 8 and max(t.n for t in tasks) <= 16
    assert {(r.seq, r.member_name) for r in rows.collect()} == {(i, f"f{i}.txt") for i in range(64)}


def test_memory_stays_near_one_member(tmp_path, monkeypatch):
    """200 MB of members in an archive of 200 MB."""
    monkeypatch.setattr(archives, "BATCH_BYTES", 4 << 20)
    path = f"{tmp_path}/big.zip"
    block = os.urandom(1 << 20)
    with zipfile.ZipFile(path, "w") as z:
        for i in range(200):
            z.writestr(f"f{i}", block)
    plan = list(ranges.planned("p", path, 150 << 20, 16 << 20))
    assert len(plan) == 13 and [r[3] for r in plan] == [16 * k for k in range(13)]
    tracemalloc.start()
    n = 0
    for _, _, _, first, last, _, _ in plan:
        for batch in archives.opened_batches(ranges.range_rows("p", path, first, last, 150 << 20, True, True)):
            n += batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200 and peak < 24 << 20


def test_faults_found_late_leave_no_artifact(spark, tmp_path):
    """The fault lies in a later range than members that were read and described already."""
    good = make_zip(("README.md", b"# Good"), ("a.py", b"x = 1\n"))
    blob = make_zip(("README.md", b"# Bad"), ("z.txt", b"q" * 60))
    (tmp_path / "good.zip").write_bytes(good)
    (tmp_path / "bad.zip").write_bytes(flipped(blob, blob.index(b"q" * 60)))
    (tmp_path / "bare.zip").write_bytes(make_zip())
    assert {r.project_id for r in analyze_corpus(spark, str(tmp_path)).collect()} == {"good", "bare"}


def test_only_requested_archives_are_opened(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(CASES["good"])
    (tmp_path / "b.zip").write_bytes(CASES["crc"])
    listing = archives.list_archives(spark, str(tmp_path))
    uploads = spark.createDataFrame([(f"file:{tmp_path}/a.zip",), (f"file:{tmp_path}/c.zip",)], "path string")
    checked = validate.validate_archives(uploads, listing, max_mb=1)
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in checked.collect()} == {"a.zip": None, "c.zip": "File does not exist"}


def test_walk_lists_every_file_once(spark, tmp_path):
    want = set()
    for name in ("a/x.txt", "a/.env", "a/b/c/d/e/f/deep.py", "a/b/__init__.py", "wide/empty.txt", "top.txt", "odd name %20/ü é.txt"):
        place = tmp_path / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text("" if "empty" in name else name)
        want.add((f"file:{place}", place.stat().st_size))
    for i in range(200):
        (tmp_path / "wide" / f"d{i}").mkdir()
        (tmp_path / "wide" / f"d{i}" / "f").write_text("x")
        want.add((f"file:{tmp_path}/wide/d{i}/f", 1))
    (tmp_path / "wide" / "loop").symlink_to(tmp_path)
    assert sorted(tuple(r) for r in folders.walk(spark, str(tmp_path)).collect()) == sorted(want)
    assert folders.walk(spark, str(tmp_path / "wide" / "d1")).count() == 1


def test_project_files_are_read_by_size(spark, tmp_path):
    for name, size in (("p/a.bin", 10), ("p/big.bin", 3000), ("q/sub/b.txt", 0), ("loose.txt", 5)):
        place = tmp_path / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(b"x" * size)
    for i in range(40):
        (tmp_path / "p" / f"m{i}").write_bytes(b"y" * 1000)
    rows = folders.scan_project_dirs(spark, str(tmp_path), max_file_mb=2000 / archives.MB, range_bytes=8 * archives.MB)
    got = {(r.project_id, r.rel_path): (r.size_bytes, None if r.content is None else len(r.content)) for r in rows.collect()}
    assert got[("p", "a.bin")] == (10, 10) and got[("q", "sub/b.txt")] == (0, 0)
    assert got[("p", "big.bin")] == (3000, None)  # larger than the limit: as good as binary
    assert len(got) == 43 and ("loose.txt", "loose.txt") not in got


def test_uploads_by_pattern(spark, tmp_path):
    for name in ("u1/a.zip", "u1/_h.zip", "u1/e.ZIP", "u1/n.txt", "u2/a.zip", "v/a.zip", "u1/deep/x.zip"):
        place = tmp_path / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(b"" if "e." in name else b"x")
    names = lambda pattern: {r.project_id: r.length for r in folders.list_uploads(spark, f"{tmp_path}{pattern}").collect()}
    assert names("/u1") == {"a": 1, "_h": 1, "e": 0}
    assert names("/u*") == {"u1/a": 1, "u1/_h": 1, "u1/e": 0, "u2/a": 1}
    assert names("/{u2,v}") == {"u2/a": 1, "v/a": 1}
    assert names("/u1/*.zip") == {"u1/a": 1, "u1/_h": 1} or names("/u1/*.zip") == {"a": 1, "_h": 1}
    assert names("/none") == {}


@pytest.mark.parametrize("damage", [False, True])
def test_archives_are_written_where_they_are_packed(spark, tmp_path, damage):
    """No task holds a batch of archives: one Python step, and the same files as rows of archives give."""
    rows = [(i, f"text {i} " * 40, "en", f"src{i % 3}", 9) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plan = corpus.saved(spark, str(tmp_path), f"file:{tmp_path}/out", damage)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "MapInPandas" not in plan.replace("FlatMapGroupsInPandas", "")
    folder = corpus.archive_folder(spark, str(tmp_path), damage).removeprefix("file:")
    found = {name: open(f"{folder}/{name}", "rb").read() for name in os.listdir(folder) if not name.startswith(".")}
    want = {f"{r.project_id}.zip": bytes(r.content) for r in corpus.packed(spark, str(tmp_path), damage).collect()}
    assert len(want) == 6 and found == want
