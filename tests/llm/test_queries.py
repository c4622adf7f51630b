"""Every registered query of the subpackage and the pipeline on the small tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import connect, difference
from ziplore.llm.queries import llm_oracles, llm_queries

SF = "/root/testdata/sf0.001"
ROWS = {
    "op1_packing": None, "op2_pii": "documents", "op3_embedding_dedup": "embeddings", "op4_url_filters": "pages",
    "op5_language_model": "documents", "op6_near_dedup": "documents", "op7_secret_scans": "documents",
    "op8_sentencepiece": "documents", "op9_quality_rules": "documents", "op10_chat": None,
    "op11_periodic_runs": "documents", "op12_html_extraction": "pages", "op13_merkle_manifest": "documents",
}


def test_all_are_registered():
    assert set(llm_queries()) == set(ROWS)
    assert set(ROWS) | {"pipeline"} <= set(entry.queries())
    assert set(llm_oracles()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ROWS))
def test_query_covers_its_table(spark, name):
    got = llm_queries()[name](spark, SF)
    if ROWS[name]:
        table = f"{SF}/{ROWS[name]}.parquet"
        assert got.count() == duckdb.connect().execute(f"SELECT count(*) FROM '{table}'").fetchall()[0][0]
    else:
        assert got.count() > 0


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_sql(spark, name):
    got = llm_queries()[name](spark, SF).toPandas()
    assert difference(got, connect(SF).execute(llm_oracles()[name]).df()) is None


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage made, by name, from documents with awkward rows."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(40, 120))), "en", "s0") for i in range(120)]
    copies = [(200 + i, rows[i][1] + " tail", "en", "s1") for i in range(10)]
    personal = [(300, rows[50][1][:150] + " " + rows[51][1][:150] + " mail a.b@c.example.com or +1 (988) 555-2485 now", "en", "s0")]
    junk = [(400, " ".join(w + "%%%$$#" for w in rows[60][1].split()), "en", "s0"), (401, "too short", "en", "s0"), (402, None, None, None), (403, "", "en", "s0")]
    long = [(500, " ".join(word() for _ in range(3000)), "en", "s0")]
    docs = rows + copies + personal + junk + long + [rows[5], (None, rows[70][1] + " but other words at its end follow here", None, None)]
    df = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    made = {"documents": df}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, df, SF).write.parquet(path)
        made[name] = df = spark.read.parquet(path)
    return made


def test_stages_keep_columns_and_order(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "redact_personal_data", "best_fit_packing"]
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_stages_take_effect(stages):
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in stages.items()}
    assert set(ids["documents"]) - set(ids["quality_rules"]) == {400, 401, 402, 403}
    assert sorted(map(str, ids["near_duplicates"])) == sorted(map(str, {*ids["quality_rules"]} - set(range(200, 210))))
    texts = {r.doc_id: r for r in stages["redact_personal_data"].collect()}
    assert texts[300].text.endswith("mail [EMAIL] or [PHONE] now") and texts[300].n_chars == len(texts[300].text)
    before = {r.doc_id: r.text for r in stages["near_duplicates"].collect()}
    assert all(r.text == before[i] or re.search(r"\[[A-Z_]+\]", r.text) for i, r in texts.items())
    assert set(ids["best_fit_packing"]) == set(ids["redact_personal_data"])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, stages, name, stage):
    assert stage(spark, stages["documents"].limit(0), SF).count() == 0


def test_distinct_texts_of_one_id_stay(spark):
    """Rows of one id are one document only where their texts are equal."""
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (1, text(1)), (1, text(2)), (2, text(3)), (3, text(3) + " tail")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, text(1)), (1, text(2)), (2, text(3))]
