import zipfile
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from ziplore.functions import kinds, paths

NAMES = [
    ".env", "foo.", "..foo", "a.tar.gz", "Dockerfile", "a..b", ".a.b", "README", "x/y/Z.TXT", "a//b/./c.py",
    "dir.d/file", "a/b.c/", "é/ñ.Md", "line\nbreak.py", "a.b\n",
]


def parts_of(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "p string")
    return df.select("p", *[c.alias(k) for k, c in paths.path_parts(F.col("p")).items()]).collect()


def test_parts_equal_pathlib(spark):
    for r in parts_of(spark, NAMES):
        p = PurePosixPath(r.p)
        assert r.name == p.name
        assert (r.stem, r.ext) == (p.stem.lower(), p.suffix.lower()), r.p
        assert tuple(r.parts) == p.parts and r.depth == len(p.parts)
        assert r.parent == ("" if str(p.parent) == "." else str(p.parent))


def test_three_dots_has_no_extension(spark):
    (row,) = parts_of(spark, ["..."])
    assert (row.stem, row.ext) == ("...", "")


def test_escape_and_landing(spark, tmp_path):
    cases = {
        "a/b": False, "../evil.txt": True, "/etc/x": True, "a/../b": False, "a/../../b": True, "./a": False,
        "a/b/../../..": True, "a//../b": False, "": False, "..a/b": False, "a/..b": False,
    }
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    rows = df.select("n", paths.escapes_root(F.col("n")).alias("e"), paths.stored_path(F.col("n")).alias("s")).collect()
    for r in rows:
        assert r.e == cases[r.n], r.n
    # Names that stay inside land where the standard library puts them.
    inside = [n for n, out in cases.items() if not out and n]
    for i, name in enumerate(inside):
        home = tmp_path / str(i)
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
            z.writestr(name, b"x")
        with zipfile.ZipFile(tmp_path / f"{i}.zip") as z:
            z.extractall(home)
        landed = [str(p.relative_to(home)) for p in home.rglob("*") if p.is_file()]
        assert landed == [next(r.s for r in rows if r.n == name)]


def test_score_and_kind(spark):
    expected = {
        "README.md": (100, "markdown"), "src/main.py": (100, "python"), "x.json": (80, "json"), "a.rst": (70, "documentation"),
        "logo.png": (10, "asset"), "Makefile": (100, "config"), "LICENSE": (100, "documentation"), "a.tsx": (10, "typescript"),
        "noext": (10, "unknown"), "conf.toml": (80, "config"),
    }
    df = spark.createDataFrame([(n,) for n in expected], "p string")
    part = paths.path_parts(F.col("p"))
    rows = df.select(
        "p", kinds.priority_score(part["stem"], part["ext"]).alias("s"), kinds.declared_kind(part["ext"], part["stem"]).alias("k")
    ).collect()
    assert {r.p: (r.s, r.k) for r in rows} == expected


def test_upload_names(spark):
    df = spark.createDataFrame([("a.zip",), ("B.ZIP",), ("a.zip.txt",), ("",), (None,)], "n string")
    assert [r[0] for r in df.select(paths.upload_name_accepted(F.col("n"))).collect()] == [True, True, False, False, False]
