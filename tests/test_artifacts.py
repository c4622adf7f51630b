import json

from pyspark.sql import functions as F

from tests import models
from ziplore import analyze_files
from ziplore.operators import enrich, validate
from ziplore.schemas import ARTIFACTS
from ziplore.sources import sinks
from ziplore.sources.summaries import read_file_summaries
from ziplore.sources.tables import files_from_table


def files(spark):
    rows = [
        ("p", 0, "README.md", "# Hello. World"), ("p", 1, "src/a.py", "def f(): pass"), ("p", 2, "src/a.py", "class B: pass"),
        ("p", 3, "data/x.png", "png"), ("q", 0, "only.txt", "One. Two."),
    ]
    df = spark.createDataFrame(rows, "p string, n int, path string, body string")
    return files_from_table(df, "p", "n", "path", "body")


def test_last_of_a_path_counts(spark):
    rows = {r.project_id: r for r in analyze_files(files(spark)).collect()}
    assert [(s.rel_path, s.summary) for s in rows["p"].file_summaries] == [
        ("README.md", "Hello. World"), ("src/a.py", "Python; classes=B")
    ]
    assert rows["p"].tree_text == models.tree("p", [(0, "README.md"), (2, "src/a.py"), (3, "data/x.png")])


def test_top_n_and_style(spark):
    rows = {r.project_id: r for r in analyze_files(files(spark), top_n=1, tree_style="flat").collect()}
    assert [s.rel_path for s in rows["p"].file_summaries] == ["README.md"]
    assert rows["p"].tree_text == "p/\nREADME.md\n  a.py\n  x.png"
    assert "(count: 1)" in rows["p"].project_summary


def test_large_projects_come_in_parts(spark):
    from ziplore.operators import artifacts, tree
    from ziplore.operators.project import project_summary
    from ziplore.operators.triage import analysable, analysis_order
    from ziplore.plans.corpus import describe_files

    rows = [("big", i, f"d{i % 3}/f{i:02d}.txt", f"Text {i}. End.") for i in range(25)] + [("small", 0, "a.txt", "x")]
    source = spark.createDataFrame(rows, "p string, n int, path string, body string")
    narrow = describe_files(files_from_table(source, "p", "n", "path", "body")).cache()
    drawn = tree.tree_text(tree.tree_lines(narrow.select("project_id", "seq", "rel_path")), lines_per_part=10)
    parts = artifacts.summary_parts(analysis_order(narrow), files_per_part=4)
    out = artifacts.assemble_artifacts(drawn, parts, project_summary(analysable(narrow))).collect()
    big = sorted((r for r in out if r.project_id == "big"), key=lambda r: r.part)
    assert [len(r.file_summaries) for r in big] == [4, 4, 4, 4, 4, 4, 1]
    assert [s.rel_path for r in big for s in r.file_summaries] == [r[2] for r in rows[:25]]
    text = "\n".join(r.tree_text for r in big if r.tree_text)
    assert text == models.tree("big", [(r[1], r[2]) for r in rows[:25]])
    assert len([r for r in out if r.project_id == "small"]) == 1


def test_sink_round_trip(spark, tmp_path):
    done = analyze_files(files(spark))
    sinks.write_artifacts(done, str(tmp_path / "a"))
    back = spark.read.schema(ARTIFACTS).json(str(tmp_path / "a")).select(*ARTIFACTS.names)
    assert sorted(map(str, back.collect())) == sorted(map(str, done.collect()))
    flat = done.select("project_id", F.inline("file_summaries"))
    sinks.write_file_summaries(flat, str(tmp_path / "s"), fmt="json")
    assert spark.read.json(str(tmp_path / "s")).count() == 3


def read(spark, texts, **options):
    df = spark.createDataFrame([(t, json.dumps(v) if not isinstance(v, str) else v) for t, v in texts.items()], "id string, summaries_json string")
    rows = read_file_summaries(df, **options).orderBy("id", "item_no").collect()
    return [(r.id, r.rel_path, r.kind, r.summary, r.lines, r.size_bytes, r.language) for r in rows]


def test_stored_summaries(spark):
    stored = {
        "a": [{"rel_path": " x\\y.py ", "kind": "python", "summary": " s ", "lines": "3", "size_bytes": 4.0, "extra": 1}],
        "b": [{"rel_path": "ok"}, {"rel_path": ""}],
        "c": [{"rel_path": "ok", "lines": -1}],
        "d": [{"rel_path": "ok", "summary": "x" * 501}],
        "e": [{"rel_path": "ok", "summary": None}],
        "f": "{not json",
        "g": "",
        "h": [{"rel_path": "t.txt"}],
        "i": [{"kind": "text"}],
    }
    assert read(spark, stored) == [
        ("a", "x/y.py", "python", "s", 3, 4, None),
        ("h", "t.txt", "unknown", "", 0, 0, None),
    ]
    legacy = read(spark, stored, mode="legacy")
    assert [r[0] for r in legacy] == ["a", "b", "b", "c", "d", "e", "h", "i"]


def test_checked_records_split(spark):
    fields = "rel_path string, kind string, summary string, lines long, size_bytes long, language string"
    rows = [("src\\m.py", "python", "x", 50, 1024, "python"), ("", "text", "", 0, 0, None), ("a", "text", "x" * 500, 0, 0, None),
            ("a", "html", "", 0, 0, None), ("\x1ca", "text", "", 0, 0, None)]
    good, bad = validate.split_checked(validate.check_file_results(spark.createDataFrame(rows, fields)))
    assert [r.rel_path for r in good.collect()] == ["src/m.py", "a", "\x1ca"]
    assert sorted(r.reject_reason for r in bad.collect()) == ["kind is not known", "rel_path is empty"]


def test_polish_keeps_draft_on_failure(spark):
    df = spark.createDataFrame([("p", "draft one"), ("q", "draft two")], "project_id string, project_summary string")

    def complete(messages, model_id, temperature):
        assert messages[0]["role"] == "system" and temperature == 0.3 and model_id == "watsonx/m"
        if messages[1]["content"].endswith("two"):
            raise RuntimeError("down")
        return "polished"

    rows = {r.project_id: tuple(r)[1:] for r in enrich.polish_summaries(df, complete, "watsonx/m").collect()}
    assert rows == {"p": ("polished", "watsonx", True, None), "q": ("draft two", "watsonx", False, "down")}
    kept = enrich.polish_summaries(df, complete, "mystery/m").collect()
    assert {(r.project_summary, r.polished, r.provider) for r in kept} == {("draft one", False, None), ("draft two", False, None)}
    assert enrich.polish_summaries(df, None, "llama3").first().provider == "ollama"
