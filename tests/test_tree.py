import random

import pytest

from tests import models
from ziplore.operators import tree


def corpus_of(n_projects=12, n_files=40):
    rng = random.Random(11)
    return {
        f"p{i}": [(seq, path) for seq, path in enumerate(models.random_paths(rng, rng.randrange(1, n_files)))]
        for i in range(n_projects)
    }


def frame(spark, corpus):
    rows = [(p, seq, path) for p, files in corpus.items() for seq, path in files]
    return spark.createDataFrame(rows, "project_id string, seq long, rel_path string").repartition(5)


@pytest.mark.parametrize(
    "style,model", [("guides", models.tree), ("flat", models.flat_tree), ("grouped", models.grouped_tree)]
)
def test_text_equals_model(spark, style, model):
    corpus = corpus_of()
    lines = tree.tree_lines(frame(spark, corpus), style)
    got = {r.project_id: r.tree_text for r in tree.tree_text(lines).collect()}
    assert got == {p: model(p, files) for p, files in corpus.items()}


@pytest.mark.parametrize("style,model", [("guides", models.tree), ("flat", models.flat_tree), ("grouped", models.grouped_tree)])
def test_text_equals_model_where_projects_and_folders_are_cut(spark, monkeypatch, style, model):
    """A project with most files, a folder with most of its files, and a folder above most folders."""
    from ziplore.operators import joins, ranking

    monkeypatch.setattr(ranking.rank_by_slices, "__defaults__", (None, None, 32, 5))
    monkeypatch.setattr(joins.hot_keys, "__defaults__", (32, 5))
    corpus = corpus_of()
    paths = [f"wide/{'ab'[i % 2]}{i}.py" for i in range(150)] + [f"wide/d{i}/x/y{i % 7}.md" for i in range(80)] + ["z.md"]
    random.Random(2).shuffle(paths)
    corpus["hot"] = [(seq * 2**50 - 2**55, path) for seq, path in enumerate(paths)]
    lines = tree.tree_lines(frame(spark, corpus), style)
    got = {r.project_id: r.tree_text for r in tree.tree_text(lines).collect()}
    assert got == {p: model(p, files) for p, files in corpus.items()}


def test_parts_join_to_the_whole(spark):
    corpus = corpus_of(3)
    lines = tree.tree_lines(frame(spark, corpus))
    parts = sorted(tree.tree_text(lines, lines_per_part=7).collect(), key=lambda r: r.part)
    for project, files in corpus.items():
        own = [r for r in parts if r.project_id == project]
        assert all(r.n_lines <= 7 for r in own)
        assert "\n".join(r.tree_text for r in own) == models.tree(project, files)


def test_projects_without_files_keep_their_root(spark):
    projects = spark.createDataFrame([("p0",), ("bare",)], "project_id string")
    lines = tree.tree_lines(frame(spark, corpus_of(1)), projects=projects)
    assert {r.project_id: r.tree_text for r in tree.tree_text(lines).collect()}["bare"] == "bare/"


def test_nodes_and_order(spark):
    files = spark.createDataFrame(
        [("p", 0, "b/x.py"), ("p", 1, "a/deep/y.py"), ("p", 2, "z.md"), ("p", 3, "b/a.py")],
        "project_id string, seq long, rel_path string",
    )
    got = {r.node: (r.parent, r.depth, r.is_dir, r.sibling_rank, r.is_last) for r in tree.tree_order(files).collect()}
    assert got == {
        "z.md": ("", 1, False, 1, False),
        "b": ("", 1, True, 2, False),
        "b/a.py": ("b", 2, False, 1, False),
        "b/x.py": ("b", 2, False, 2, True),
        "a": ("", 1, True, 3, True),
        "a/deep": ("a", 2, True, 1, True),
        "a/deep/y.py": ("a/deep", 3, False, 1, True),
    }


def test_unknown_style(spark):
    with pytest.raises(ValueError):
        tree.tree_lines(frame(spark, corpus_of(1)), "fancy")
