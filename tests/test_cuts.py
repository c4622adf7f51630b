"""Messages are cut by time without a task that holds all times."""

import random

import pytest
from pyspark.sql import functions as F

from checks import corpus

SHARES = [k / corpus.CUTS for k in range(corpus.CUTS + 1)]


@pytest.mark.parametrize(
    "values",
    [
        [5],
        [7, 7, 7, 7],
        [1, 2],
        [-9, None, 4, 4, 1_700_000_000_000_000, None, -3],
        [random.Random(3).randrange(-(10**9), 2 * 10**15) for _ in range(501)],
        [random.Random(4).randrange(40) for _ in range(300)],
    ],
)
def test_percentiles_equal_sparks_own(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    want = rows.select(F.percentile("v", F.array(*[F.lit(s) for s in SHARES]))).first()[0]
    assert corpus.percentiles(rows, "v", SHARES) == want


def test_percentiles_of_nothing(spark):
    assert corpus.percentiles(spark.createDataFrame([], "v long"), "v", SHARES) == [0.0] * len(SHARES)


def test_no_plan_of_the_cuts_holds_all_times_in_one_task(spark, tmp_path, monkeypatch):
    """`percentile` collects every time that differs; groupings on parts of the span do not."""
    monkeypatch.setattr(F, "percentile", lambda *a: pytest.fail("all times in one task"))
    events = spark.range(1000).selectExpr(
        "id AS event_id", "timestamp_micros(id * id * 1000003) AS ts", "id % 7 AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props"
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    folder = corpus.messages_in_cuts(spark, str(tmp_path))
    cuts = [spark.read.parquet(f"{folder}/cut={k}") for k in range(corpus.CUTS)]
    assert [c.count() for c in cuts] == [333, 333, 334]
    assert sorted(r.event_id for c in cuts for r in c.collect()) == list(range(1000))
