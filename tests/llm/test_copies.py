"""Copies of a text cost no second sketch, and no shuffle of texts while few documents are kept."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ziplore.llm import near_dedup
from ziplore.llm.near_dedup import near_duplicates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, words=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(words))


def copied(spark, texts, times):
    rows = [(k * len(texts) + i, t, "en", "web", len(t)) for k in range(times) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("ids", [2_000_000, 4, 2], ids=["others", "firsts", "neither"])
@pytest.mark.parametrize("times", [1, 5])
def test_each_text_is_sketched_once(spark, monkeypatch, times, ids):
    """Whichever ids go to the texts: those that stand for themselves, the others, or none."""
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", ids)
    docs = copied(spark, [text(1), text(2), text(3)], times)
    more = spark.createDataFrame([(100, None, "en", "web", 0), (101, " \n\t", "en", "web", 3), (None, text(1), "en", "web", 9)], DOCS)
    seen = spark.sparkContext.accumulator(0)
    sketches = near_dedup.sketches

    def counted(rows, common):
        seen.add(rows.count())
        return sketches(rows, common)

    monkeypatch.setattr(near_dedup, "sketches", counted)
    got = near_duplicates(docs.unionByName(more)).collect()
    want = {(i, i % 3, i < 3) for i in range(3 * times)} | {(100, 100, True), (101, 101, True), (None, None, True)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    if ids > 2 and times > 1:
        assert seen.value <= 5  # two texts without words besides


def test_few_kept_documents_are_found_without_moving_texts(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 5)
    docs = copied(spark, [text(1), text(2), text(3)], 6)
    docs = docs.unionByName(spark.createDataFrame([(None, text(1), "en", "web", 9)], DOCS))
    moved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rest = corpus_pipeline.near_duplicates(spark, docs, "")
        plan = rest._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert sorted((r.doc_id is None, r.doc_id) for r in rest.collect()) == [(False, 0), (False, 1), (False, 2), (True, None)]
        assert rest.columns == docs.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", moved)


def test_shingles_of_a_batch_stay_within_their_texts(spark):
    """A chunk's words are shingled in one go; windows over the end of a text are left out."""
    import pyarrow as pa

    from ziplore.llm.words import bags

    texts = ["a b c d e f", None, "", "g", "h i j k", " l m n o p ", "q " * 40_000, "r s t u v w x"]
    column = pa.array(texts, pa.string())
    want = [near_dedup._shingled(w) for w in bags(column)]
    got = [s.copy() for s in near_dedup.shingled_texts(column)]
    assert [g.tolist() for g in got] == [w.tolist() for w in want]
    assert [len(g) for g in got] == [2, 0, 0, 1, 1, 1, 39_996, 3]


def test_unlike_texts_of_a_large_bucket_meet_in_few_rounds(spark, monkeypatch):
    """Forty texts in one bucket, two of them near copies: a round for each text would be 36 of them."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    texts = [text(k) for k in range(40)]
    texts[31] = texts[17] + " tail"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(
        "doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")
    )
    common = spark.sparkContext.broadcast(np.ones(near_dedup.COUNTERS, np.float32))
    nodes = near_dedup.sketches(docs, common).withColumn("buckets", F.array(F.lit(7).cast("long")))
    rounds, likely = [], near_dedup._likely

    def counted(*args):
        rounds.append(1)
        if len(rounds) > 8:
            pytest.fail("a round for each text")
        return likely(*args)

    monkeypatch.setattr(near_dedup, "_likely", counted)
    got = {r.id: r.component for r in near_dedup._components(nodes, docs, common).collect()}
    assert got == {17: 17, 31: 17} and len(rounds) <= near_dedup.ROUNDS
