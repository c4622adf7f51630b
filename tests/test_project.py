import random

from tests import models
from ziplore.operators import project
from ziplore.operators.validate import check_project_summary

SCHEMA = "project_id string, seq long, score int, rel_path string, kind string, summary string, lines long, size_bytes long, language string"
PATHS = [
    "README.md", "readme.txt", "docs/README.md", "setup.py", "mysetup.py", "sub/pyproject.toml", "package.json", "Dockerfile",
    "x.dockerfile", "go.mod", "pom.xml", "a.py", "b.txt", "Readme",
]


def random_results(n_projects=150, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n_projects):
        for seq in range(rng.randrange(1, 9)):
            summary = rng.choice(["Short", "Ends with dots...", "", "x" * 290, "Long é " * 40 + "."])
            kind = rng.choice(["text", "python", "json"])
            rows.append((f"p{i}", seq, rng.choice([100, 80, 10]), rng.choice(PATHS), kind, summary, seq, seq * 2,
                         "python" if kind == "python" else None))
    return rows


def in_order(rows):
    grouped = {}
    for r in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        grouped.setdefault(r[0], []).append({"rel_path": r[3], "kind": r[4], "summary": r[5]})
    return grouped


def test_overview_equals_model(spark):
    rows = random_results()
    projects = spark.createDataFrame([(p,) for p in [*in_order(rows), "bare"]], "project_id string")
    got = project.project_summary(spark.createDataFrame(rows, SCHEMA), projects)
    expected = {p: models.overview(found) for p, found in in_order(rows).items()} | {"bare": models.overview([])}
    assert {r.project_id: r.project_summary for r in got.collect()} == expected


def test_single_aggregates_agree_with_overview(spark):
    df = spark.createDataFrame(random_results(), SCHEMA)
    whole = {r.project_id: r for r in project.project_summary(df).collect()}
    assert {r.project_id: r.stack for r in project.guess_stack(df).collect()} == {p: r.stack for p, r in whole.items()}
    kinds = {r.project_id: (r.dominant_kind, r.dominant_count) for r in project.dominant_kind(df).collect()}
    assert kinds == {p: (r.dominant_kind, r.dominant_count) for p, r in whole.items()}
    lines = {r.project_id: r.readme_line for r in project.readme_line(df).collect()}
    assert set(lines) == set(whole)


def test_one_stats_row_per_project(spark):
    rows = [("u/p", i, 80, f"d{i % 5}/f{i}.py", "python", "s", 2, 3, "python") for i in range(20)]
    rows += [("u/p", 99, 80, "d0/more.js", "text", "s", 1, 1, "javascript"), ("q", 0, 10, "top", "text", "s", 1, 1, None)]
    stats = project.project_stats(spark.createDataFrame(rows, SCHEMA), top_components=2)
    p, q = sorted(stats.collect(), key=lambda r: r.project_id, reverse=True)
    assert (p.project_name, p.key_components, p.component_count) == ("p", ["d0", "d1"], 5)
    assert (p.file_count, p.line_count, p.total_bytes) == (21, 41, 61)
    assert p.languages == ["python", "javascript"]
    assert p.architecture_notes == "Top-level components: d0, d1."
    assert (q.key_components, q.component_count, q.languages, q.frameworks) == ([], 0, [], [])
    judged = check_project_summary(stats).collect()
    assert [r.reject_reason for r in judged] == [None, None]


def test_order_holds_for_any_member_number(spark):
    """Numbers beyond 2^48, negative ones and sparse ones."""
    rows = [
        ("p", 2**62, 100, "README.md", "text", "far", 1, 1, None),
        ("p", -(2**62), 70, "readme.rst", "text", "low score", 1, 1, None),
        ("p", 2**61, 100, "README", "text", "first", 1, 1, None),
        ("n", -5, 100, "README.md", "text", "minus", 1, 1, None),
        ("n", 3, 100, "README.txt", "text", "plus", 1, 1, None),
    ]
    lines = project.readme_line(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.project_id: r.readme_line for r in lines} == {"p": "first.", "n": "minus."}
