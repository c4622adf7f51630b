import io
import json
import struct
import zipfile

import pytest

from ziplore import analyze_corpus, analyze_files, analyze_project_dirs
from ziplore.operators import validate
from ziplore.plans.corpus import corpus_verdicts
from ziplore.sources import archives


def make_zip(*members, method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with pytest.warns(UserWarning) if len({n for n, _ in members}) < len(members) else _quiet():
        with zipfile.ZipFile(out, "w", method) as z:
            for name, body in members:
                z.writestr(name, body)
    return out.getvalue()


class _quiet:
    def __enter__(self):
        return self

    def __exit__(self, *exc):
        return False


def flipped(blob, at):
    data = bytearray(blob)
    data[at] ^= 0xFF
    return bytes(data)


def lying(blob):
    """Declare one byte less than is stored, in both headers."""
    data = bytearray(blob)
    for sign, offset in ((b"PK\x03\x04", 22), (b"PK\x01\x02", 24)):
        at = data.index(sign) + offset
        size = struct.unpack_from("<I", data, at)[0]
        struct.pack_into("<I", data, at, size - 1)
    return bytes(data)


CASES = {
    "good": make_zip(("a.txt", b"hi"), ("d/b.py", b"x = 1\n")),
    "slip": make_zip(("ok.txt", b"1"), ("../evil.txt", b"2")),
    "absolute": make_zip(("/etc/x", b"1")),
    "inside": make_zip(("a/../b", b"1")),
    "crc": flipped(make_zip(("first", b"abc"), ("second", b"def")), 30 + len("first")),
    "junk": b"this is not an archive",
    "nothing": b"",
    "empty": make_zip(),
    "dirs": make_zip(("only/", b""), ("only/deeper/", b"")),
    "twice": make_zip(("x.txt", b"old"), ("y.txt", b"y"), ("x.txt", b"new")),
    "large": make_zip(("small", b"1"), ("big.bin", b"0" * 3000), method=zipfile.ZIP_DEFLATED),
    "liar": lying(make_zip(("lie", b"abcdef"))),
}
REASONS = {
    "slip": "Illegal member path: ../evil.txt",
    "absolute": "Illegal member path: /etc/x",
    "crc": "CRC error in member: first",
    "junk": "Not a ZIP archive",
    "nothing": "Not a ZIP archive",
    "large": "Member big.bin exceeds 0.00195312 MB",
    "liar": "CRC error in member: lie",
}


@pytest.fixture(scope="module")
def opened(spark):
    df = spark.createDataFrame(list(CASES.items()), "project_id string, content binary")
    return archives.open_archives(df, max_member_mb=2048 / archives.MB).collect()


def test_every_archive_has_one_verdict(opened):
    verdicts = {r.project_id: r.reject_reason for r in opened if r.seq is None}
    assert verdicts == {name: REASONS.get(name) for name in CASES}


def test_rejected_archives_release_nothing(opened):
    released = {r.project_id for r in opened if r.seq is not None}
    assert released == {"good", "inside", "twice"}


def test_members(opened):
    rows = {(r.project_id, r.seq): (r.rel_path, r.size_bytes, bytes(r.content)) for r in opened if r.seq is not None}
    assert rows == {
        ("good", 0): ("a.txt", 2, b"hi"),
        ("good", 1): ("d/b.py", 6, b"x = 1\n"),
        ("inside", 0): ("a/b", 1, b"1"),
        ("twice", 1): ("y.txt", 1, b"y"),
        ("twice", 2): ("x.txt", 3, b"new"),
    }


def test_members_come_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(archives, "BATCH_ROWS", 3)
    blob = make_zip(*[(f"f{i}", b"x" * i) for i in range(20)])
    df = spark.createDataFrame([("p", blob), ("q", blob)], "project_id string, content binary")
    rows = archives.explode_members(df).collect()
    assert sorted((r.project_id, r.seq, r.size_bytes) for r in rows) == [(p, i, i) for p in "pq" for i in range(20)]


def test_dedupe_operator_agrees(spark):
    df = spark.createDataFrame([("twice", CASES["twice"])], "project_id string, content binary")
    kept = archives.explode_members(df, dedupe=False)
    assert kept.count() == 3
    assert sorted(r.seq for r in validate.dedupe_members(kept).collect()) == [1, 2]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    home = tmp_path_factory.mktemp("uploads")
    for name, blob in CASES.items():
        (home / f"{name}.zip").write_bytes(blob)
    (home / "UPPER.ZIP").write_bytes(CASES["good"])
    (home / "notes.txt").write_text("no archive")
    (home / "huge.zip").write_bytes(CASES["good"] + b"\0" * 5000)
    return str(home)


def test_scan_takes_any_case_and_skips_large(spark, folder):
    listed = {r.project_id for r in archives.list_archives(spark, folder).collect()}
    assert listed == {*CASES, "UPPER", "huge"} - {"nothing"}  # zero bytes
    scanned = archives.scan_archives(spark, folder, max_mb=4096 / archives.MB)
    assert {r.project_id for r in scanned.select("project_id").collect()} == listed - {"huge"}


def test_size_filter_reaches_the_source(spark, folder):
    scan = archives.scan_archives(spark, folder, max_mb=1)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1048576)" in plan
    listing = archives.list_archives(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in listing


def test_validate_archives(spark, folder):
    limit = 4096 / archives.MB
    listing = archives.list_archives(spark, folder)
    contents = archives.scan_archives(spark, folder, max_mb=limit)
    wanted = [(f"file:{folder}/{n}.zip",) for n in ("good", "crc", "junk", "huge", "gone", "slip")]
    checked = validate.validate_archives(spark.createDataFrame(wanted, "path string"), listing, contents, max_mb=limit)
    got = {r.path.rsplit("/", 1)[1]: (r.reason, r.is_valid) for r in checked.collect()}
    assert got == {
        "good.zip": (None, True),
        "slip.zip": (None, True),  # member paths are the extraction's business
        "crc.zip": ("CRC error in member: first", False),
        "junk.zip": ("Not a ZIP archive", False),
        "huge.zip": ("Archive exceeds 0.00390625 MB", False),
        "gone.zip": ("File does not exist", False),
    }


SAMPLE = [
    ("README.md", "# Test Project\nA sample project."),
    ("main.py", "def main():\n    print('Hello, World!')\n\nif __name__ == '__main__':\n    main()"),
    ("config.json", '{"version": "1.0.0"}'),
]


def test_sample_archive_end_to_end(spark, tmp_path):
    (tmp_path / "test_project.zip").write_bytes(make_zip(*SAMPLE))
    (tmp_path / "bad.zip").write_bytes(CASES["slip"])
    (tmp_path / "bare.zip").write_bytes(CASES["empty"])
    rows = {r.project_id: r for r in analyze_corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {"test_project", "bare"}
    done = rows["test_project"]
    assert [(s.rel_path, s.kind, s.summary) for s in done.file_summaries] == [
        ("README.md", "text", "Test Project"),
        ("main.py", "python", "Python; funcs=main"),
        ("config.json", "json", "JSON with keys: version"),
    ]
    assert done.tree_text == "test_project/\n├── README.md\n├── config.json\n└── main.py"
    assert done.project_summary == (
        "Test Project. The dominant file type is *text* (count: 1). "
        "Inferred tech stack: Unknown or mixed‐language project."
    )
    bare = rows["bare"]
    assert (bare.tree_text, bare.file_summaries) == ("bare/", [])
    assert bare.project_summary.startswith("The dominant file type is *unknown* (count: 0).")


def test_unpacked_directories(spark, tmp_path):
    for name, body in [*SAMPLE, ("pkg/__init__.py", ""), (".env", "A=1"), ("pkg/logo.png", "x")]:
        place = tmp_path / "proj" / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(body)
    (row,) = analyze_project_dirs(spark, str(tmp_path)).collect()
    assert {s.rel_path for s in row.file_summaries} == {
        "README.md", "main.py", "config.json", "pkg/__init__.py", ".env"
    }
    assert row.tree_text.splitlines()[0] == "proj/"
    assert "    ├── __init__.py" in row.tree_text and "    └── logo.png" in row.tree_text


def test_guards_on_member_tables(spark):
    rows = [("a", 0, "x", 5), ("a", 1, "../y", 5), ("b", 0, "x", 50), ("b", 1, "/y", 5), ("c", 0, "x", 5)]
    df = spark.createDataFrame(rows, "project_id string, seq long, member_name string, size_bytes long")
    limit = 10 / archives.MB
    reasons = {r.project_id: r.reason for r in validate.extraction_status(df, limit).collect()}
    assert reasons == {"a": "Illegal member path: ../y", "b": "Member x exceeds 9.53674e-06 MB", "c": None}
    assert {r.project_id for r in validate.member_size_guard(df, limit).collect()} == {"a", "c"}
    assert {r.project_id for r in validate.zip_slip_guard(df).collect()} == {"c"}
    kept = validate.exclude_rejected(df, validate.extraction_status(df, limit))
    assert {r.project_id for r in kept.collect()} == {"c"}


def test_size_limit_is_strict(spark):
    df = spark.createDataFrame([(archives.MB,), (archives.MB + 1,), (archives.MB * 5 // 4,)], "size long")
    rows = validate.size_limit(df, "size", 1).collect()
    assert [r.too_large for r in rows] == [False, True, True]
    assert rows[2].size_error == "Archive exceeds 1 MB (1.2 MB)"


def test_equal_names_in_two_folders_are_two_projects(spark, tmp_path):
    for sub, text in (("u1", "one"), ("u2", "two")):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "app.zip").write_bytes(make_zip(("README.md", f"# {text}")))
    rows = {r.project_id: r for r in analyze_corpus(spark, f"{tmp_path}/*").collect()}
    assert set(rows) == {"u1/app", "u2/app"}
    assert [f.summary for f in rows["u2/app"].file_summaries] == ["two"]


def test_whole_files_are_parsed(spark):
    """Names after byte 64,000 and a character across it."""
    filler = "x = '" + "y" * 63_990 + "éé'\n"
    files = {
        "late.py": filler + "def late():\n    pass\n",
        "big.json": json.dumps({"first": "z" * 70_000, "last": 1}),
        "odd.txt": "a" * 63_999 + "é end",
    }
    rows = [("p", i, name, text.encode()) for i, (name, text) in enumerate(files.items())]
    df = spark.createDataFrame(rows, "project_id string, seq long, rel_path string, content binary")
    (artifact,) = analyze_files(df).collect()
    got = {f.rel_path: f.summary for f in artifact.file_summaries}
    assert got["late.py"] == "Python; funcs=late"
    assert got["big.json"] == "JSON with keys: first, last"
    assert got["odd.txt"] == "a" * 160 + "…"


def test_every_upload_has_a_verdict(spark, tmp_path):
    good = make_zip(*SAMPLE)
    uploads = {
        "good.zip": good, "_hidden.zip": good, ".dot.zip": good, "empty.zip": b"", "junk.zip": b"no archive",
        "huge.zip": make_zip(("big.bin", b"x" * 5000)), "slips.zip": make_zip(("../evil", b"x")), "note.txt": b"x",
    }
    for name, content in uploads.items():
        (tmp_path / name).write_bytes(content)
    limit = 4096 / archives.MB
    got = {r.project_id: r.reason for r in corpus_verdicts(spark, str(tmp_path), max_archive_mb=limit).collect()}
    assert got == {
        "good": None, "_hidden": "Name is hidden from file sources", ".dot": "Name is hidden from file sources",
        "empty": "Not a ZIP archive", "junk": "Not a ZIP archive", "huge": f"Archive exceeds {limit:g} MB",
        "slips": "Illegal member path: ../evil",
    }
    artifacts = analyze_corpus(spark, str(tmp_path), max_archive_mb=limit)
    assert {r.project_id for r in artifacts.collect()} == {p for p, reason in got.items() if reason is None}
