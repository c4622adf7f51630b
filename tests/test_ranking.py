import random

import pytest
from pyspark.sql import functions as F

from ziplore.operators import ranking, reports, triage


def skewed(n=3000, seed=1):
    """A third of all rows belong to one key."""
    rng = random.Random(seed)
    rows, next_seq = [], {}
    for _ in range(n):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}"
        seq = next_seq.get(key, 0)
        next_seq[key] = seq + rng.choice([1, 1, 1, 7])
        rows.append((key, seq, rng.choice([100, 80, 70, 10]), f"{rng.choice('abZé')}{rng.randrange(10**6)}"))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "project_id string, seq long, score int, name string").repartition(7)


def expected(rows, order):
    ranks, seen = {}, {}
    for row in sorted(rows, key=order):
        seen[row[0]] = seen.get(row[0], 0) + 1
        ranks[row[0], row[1]] = seen[row[0]]
    return ranks


def ranks_of(df, out):
    return {(r.project_id, r.seq): r[out] for r in df.collect()}


CUTS = [{"share": 64, "least": 20}, {"share": 5, "least": 1}, {"share": 5, "least": 10**6}]


@pytest.mark.parametrize("cut", CUTS)
def test_rank_by_slices(spark, cut):
    rows = skewed()
    df = frame(spark, rows)
    by_score = ranking.rank_by_slices(df, ["project_id"], [-F.col("score"), "seq"], "rank", **cut)
    assert ranks_of(by_score, "rank") == expected(rows, lambda r: (-r[2], r[1]))
    by_name = ranking.rank_by_slices(df, ["project_id"], ["name", "seq"], "rank", value="score", **cut)
    ordered = sorted(rows, key=lambda r: (r[0], r[3].encode(), r[1]))
    sums, want = {}, {}
    for key, seq, score, _ in ordered:
        want[key, seq] = sums.get(key, 0)
        sums[key] = want[key, seq] + score
    got = by_name.collect()
    assert {(r.project_id, r.seq): r["rank"] for r in got} == expected(rows, lambda r: (r[3].encode(), r[1]))
    assert {(r.project_id, r.seq): r.score_before for r in got} == want


@pytest.mark.parametrize("spread", [lambda n: n, lambda n: n * 2**40, lambda n: n * 2**50 - 2**62, lambda n: -(n**5)])
def test_any_seq_is_ranked(spark, spread):
    """Dense, sparse, beyond 2 ** 48 and negative; the hot project is cut into slices of like size."""
    rows = [("hot" if n % 3 else f"k{n % 50}", spread(n), 10, "f") for n in range(3000)]
    cut = {"share": 64, "least": 20}
    got = ranking.rank_by_slices(frame(spark, rows), ["project_id"], ["seq"], "rank", **cut)
    assert ranks_of(got, "rank") == expected(rows, lambda r: r[1])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = ranking.rank_by_slices(frame(spark, rows), ["project_id"], ["seq"], "rank", **cut)
        sizes = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        # Two thirds of the rows are one project's; no window holds more than a few of its slices.
        assert max(sizes) < 300
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rank_by_slices_of_no_rows(spark):
    assert ranking.rank_by_slices(frame(spark, skewed(3)).limit(0), ["project_id"], ["seq"], "rank").count() == 0


def test_rank_by_sort_spreads_one_key(spark):
    rows = skewed()
    df = frame(spark, rows)
    got = ranking.rank_by_sort(df, ["project_id"], ["name", "seq"], "rank")
    assert ranks_of(got, "rank") == expected(rows, lambda r: (r[3].encode(), r[1]))
    # One key alone, over several partitions of the range sort.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = [r for r in rows if r[0] == "hot"]
        ranked = ranking.rank_by_sort(frame(spark, hot), ["project_id"], ["name", "seq"], "rank")
        assert ranks_of(ranked, "rank") == expected(hot, lambda r: (r[3].encode(), r[1]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_top_per_key(spark):
    rows = skewed()
    got = ranking.top_per_key(
        frame(spark, rows), ["project_id"], [F.desc("score"), F.asc("seq")], "seq", 20, "rank"
    )
    full = expected(rows, lambda r: (-r[2], r[1]))
    assert ranks_of(got, "rank") == {k: v for k, v in full.items() if v <= 20}


def test_limits_are_applied_before_the_shuffle(spark):
    df = frame(spark, skewed(50))
    got = ranking.top_per_key(df, ["project_id"], [F.desc("score"), F.asc("seq")], "seq", 20, "rank")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") >= 2


def test_report_counts_the_rest(spark):
    rows = [("p", i, 80, f"f{i}") for i in range(53)] + [("q", 0, 80, "only")]
    df = frame(spark, rows).withColumnsRenamed({"name": "rel_path"}).withColumns(
        {"kind": F.lit("text"), "lines": F.lit(3), "summary": F.repeat(F.lit("x"), F.lit(120))}
    )
    got = sorted(reports.file_report(df).filter("project_id = 'p'").collect(), key=lambda r: r.row_no)
    assert len(got) == 51 and got[0].path == "f0" and len(got[0].summary) == 100
    assert tuple(got[-1])[2:] == ("...", "+3 more", "...", "")
    assert reports.file_report(df).filter("project_id = 'q'").count() == 1


def test_triage_views(spark):
    rows = [
        ("p", 0, "README.md", b"hi"), ("p", 1, "x.bin", b"\x01" * 9), ("p", 2, "a.png", b"text"),
        ("p", 3, "z.py", b""), ("p", 4, "b.txt", b"b"), ("p", 5, "gone.md", None),
    ]
    df = spark.createDataFrame(rows, "project_id string, seq long, rel_path string, content binary")
    out = triage.triage(df)
    assert {r.rel_path for r in triage.skipped_files(out).collect()} == {"x.bin", "a.png", "gone.md"}
    order = sorted(triage.analysis_order(out.drop("content")).collect(), key=lambda r: r["rank"])
    assert [(r.rel_path, r.score) for r in order] == [("README.md", 100), ("z.py", 80), ("b.txt", 70)]
    assert {(r.ext, r.n) for r in triage.skip_counts(out).collect()} == {(".bin", 1), (".png", 1), (".md", 1)}
