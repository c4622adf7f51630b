"""Merkle manifest against a tree built node by node."""

import hashlib
import random
import zlib

import pytest

from checks.compare import difference
from ziplore.llm import merkle
from ziplore.llm.queries import OP13_SQL, ORACLES, op13_merkle_manifest

H = lambda text: hashlib.sha256(text.encode()).hexdigest()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(digests):
    """The root, and for every leaf the siblings to the left and right at each level."""
    levels = [digests]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H("".join(now[i : i + 16])) for i in range(0, len(now), 16)])
    paths = []
    for i in range(len(digests)):
        path = []
        for now in levels[:-1]:
            first = i // 16 * 16
            path.append(("".join(now[first:i]), "".join(now[i + 1 : first + 16])))
            i //= 16
        paths.append(path)
    return levels[-1][0], paths


def expected(rows):
    """Rows of the query, in a tree over trees."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = (ordered, *climbed([leaf(r) for r in ordered]))
    root, tops = climbed([trees[name][1] for name in names])
    out = []
    for name, top in zip(names, tops):
        ordered, subroot, paths = trees[name]
        for row, path in zip(ordered, paths):
            path = path + top
            held = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                lowered = "".join(c.lower() if c.isascii() else c for c in row[4])
                held = leaf((*row[:4], lowered))
            for before, after in path:
                held = H(before + held + after)
            out.append((row[0], leaf(row), subroot, root, H("".join(b + a for b, a in path)), held, held == root))
    return out


def got(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in op13_merkle_manifest(spark, str(tmp_path)).collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r))


def made(sizes, seed=1):
    rng = random.Random(seed)
    ids = iter(rng.sample(range(-5, 10**6), sum(n for _, n in sizes)))
    text = lambda: " ".join(rng.choice(["Aa", "é", "ß Z", "x", "\n", ""]) for _ in range(rng.randrange(6)))
    return [(next(ids), name, rng.choice(["en", None]), rng.choice([None, 7]), text()) for name, n in sizes for _ in range(n)]


@pytest.mark.parametrize(
    "sizes",
    [
        [("a", 1)],
        [("a", 1), (None, 1), ("é", 1), ("", 2), ("B", 16), ("z", 17)],
        [("hot", 16 * 16 * 16 + 1), ("b", 256), ("c", 257), ("d", 15)],
        [(f"s{i}", 1 + i % 3) for i in range(300)],
    ],
)
def test_equals_node_by_node(spark, tmp_path, sizes):
    rows = made(sizes)
    assert by_id(got(spark, tmp_path, rows)) == by_id(expected(rows))


def test_awkward_rows(spark, tmp_path):
    rows = [
        (1, "a", None, None, None), (2, "a", "", 0, ""), (3, None, "en", 3, "Abc"), (None, "a", "en", 1, "X"), (None, None, None, None, None),
        *[(5, "a", "en", 4, "SAME")] * 20, (5, "a", "en", 4, "other"), (10, "a", "en", 10**6, "Long É " * 150_000), (-7, "ä", "en", 1, "T"),
    ]
    assert by_id(got(spark, tmp_path, rows)) == by_id(expected(rows))


def test_extra_columns_and_empty_table(spark, tmp_path):
    rows = made([("a", 20), ("b", 3)])
    wide = [(*r, "t", 1, "d", "p") for r in rows]
    schema = f"{SCHEMA}, tree string, lo long, digest string, path string"
    assert by_id(got(spark, tmp_path / "wide", wide, schema)) == by_id(expected(rows))
    assert got(spark, tmp_path / "none", [], SCHEMA) == []


def test_any_change_is_seen(spark):
    """A changed leaf never folds to the root; each level's interval holds its children's."""
    rows = made([("a", 700), ("b", 40)])
    docs = spark.createDataFrame([(r[0], r[1], leaf(r)) for r in rows], "doc_id long, source string, leaf string")
    manifest = merkle.build_manifest(docs, "leaf", "source", "doc_id", ["doc_id"])
    proofs = merkle.prove(manifest)
    assert proofs.filter(merkle.folded(merkle.digest(proofs["leaf"])) == proofs["root"]).count() == 0
    assert proofs.filter(merkle.folded(proofs["leaf"]) == proofs["root"]).count() == 740
    for level in manifest.levels[1:]:
        for node in level.collect():
            assert [c["lo"] for c in node["children"]] == sorted(c["lo"] for c in node["children"])
            assert (node["children"][0]["lo"], node["children"][-1]["hi"]) == (node["lo"], node["hi"])
            assert all(a["hi"] == b["lo"] for a, b in zip(node["children"], node["children"][1:]))
            assert len(node["children"]) <= merkle.ARITY


def test_sql_equals_query_where_rows_repeat(spark, tmp_path):
    rows = made([("a", 300), (None, 2), ("b", 1)]) + [(5, "a", "en", 4, "SAME")] * 3 + [(None, "b", None, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sql = ORACLES["op13_merkle_manifest"]
    assert "{" not in sql and sql != OP13_SQL
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(op13_merkle_manifest(spark, str(tmp_path)).toPandas(), con.execute(sql).df()) is None
