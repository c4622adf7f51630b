"""Physical plans: what stays in the JVM, what is pruned, what may not appear."""

import pytest
from pyspark.sql import functions as F

from checks import corpus, queries
from ziplore.operators import jobs, project, tree, triage
from ziplore.session import pin

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = (
    "src4 src5 val2 val3 val4 val5 val6 val7 val8 val9 val10 fn1 fn2 fn3 fn4 fn5 fn6_objects fn10 fn11 fn12 fn13 "
    "tri1 tri3 tri4 agg1 agg2 tre1 job1 job2 job3 job4 job5 jn3"
).split()


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_have_no_python_and_no_cross_join(spark, name):
    plan = plan_of(queries.all_queries()[name](spark, SF))
    for node in ("EvalPython", "InPandas", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, node


def test_paths_alone_do_not_read_text(spark):
    plan = plan_of(triage.with_name_parts(corpus.files(spark, SF)).select("project_id", "ext"))
    assert "text" not in plan.split("ReadSchema:")[1]


def test_describing_files_needs_no_shuffle(spark):
    from ziplore.plans.corpus import describe_files

    plan = plan_of(describe_files(corpus.files(spark, SF)))
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_content_is_gone_before_the_first_shuffle(spark):
    plan = plan_of(queries.described(spark, SF))
    above = plan.split("Exchange")[0]
    assert "content" not in above.split("WindowGroupLimit")[0]


def test_large_groupings_are_hash_aggregates(spark):
    narrow = pin(queries.described(spark, SF))
    for df in (project.stack_flags(narrow), project.kind_counts(narrow), project.corpus_stats(narrow)):
        assert "SortAggregate" not in plan_of(df)


def test_no_window_sorts_a_whole_job(spark):
    log = corpus.job_messages(spark, SF)
    for df in (jobs.events_until_close(log), jobs.job_status(log)):
        assert "Window" not in plan_of(df)


def test_ranks_and_trees_are_not_sorted_over_the_corpus(spark):
    rows = pin(spark.range(100).select((F.col("id") % 3).cast("string").alias("project_id"), F.col("id").alias("seq"), F.lit(10).alias("score"),
                                       F.lit(None).cast("string").alias("skip_reason"), F.concat(F.lit("d/"), F.col("id").cast("string")).alias("rel_path")))
    paths = rows.select("project_id", "seq", "rel_path")
    for df in (triage.analysis_order(rows), triage.number_by_path(paths.drop("seq")), tree.tree_order(paths), tree.file_order(paths),
               *(tree.tree_lines(paths, style) for style in tree.STYLES)):
        assert "rangepartitioning" not in plan_of(df)


def test_each_file_is_analysed_once(spark, tmp_path):
    """Analyser calls of unpacked folders and of archives, counted by the rows they write."""
    import uuid
    import zipfile

    from ziplore import analyze_corpus, analyze_project_dirs

    calls = tmp_path / "calls"
    calls.mkdir()

    def analyser(text):
        (calls / uuid.uuid4().hex).touch()
        return "text", text[:5]

    for i in range(20):
        place = tmp_path / "projects" / f"p{i % 3}" / "sub" / f"f{i}.cfg"
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(f"file {i}")
    assert analyze_project_dirs(spark, str(tmp_path / "projects"), analyzers={".cfg": analyser}).count() == 3
    assert len(list(calls.iterdir())) == 20
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips" / "a.zip", "w") as z:
        for i in range(20):
            z.writestr(f"f{i}.cfg", f"file {i}")
    assert analyze_corpus(spark, str(tmp_path / "zips"), analyzers={".cfg": analyser}).count() == 1
    assert len(list(calls.iterdir())) == 40


def test_a_dominant_job_is_spread_over_the_join(spark):
    n = 60_000
    job = F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 500)
    msg = F.when(F.col("id") == n - 2, "close").when(F.col("id") % 3 == 0, "event:NewUpload").otherwise("event:TreeBuilt")
    log = spark.range(0, n, 1, 8).select(
        job.cast("long").alias("job_id"), F.col("id").alias("event_id"),
        F.timestamp_seconds(F.col("id")).alias("ts"), msg.alias("msg"),
    )
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
                "spark.sql.shuffle.partitions": "16"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = jobs.events_until_close(log)
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        # Half of the rows are one job's; no task has more than a quarter.
        assert sum(sizes) == n - 1 and max(sizes) < n / 4
        status = jobs.job_status(log)
        assert {r.job_id: r.latest_stage for r in status.collect()}[1] == "synthesizing"
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
