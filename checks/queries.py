"""One query per operator over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import corpus
from ziplore.functions import kinds, parsers, paths, text
from ziplore.functions.binary import looks_binary
from ziplore.operators import artifacts, enrich, jobs, project, reports, results, tree, triage, validate
from ziplore.plans import corpus as plans
from ziplore.schemas import ARTIFACTS
from ziplore.session import pin, scratch_path
from ziplore.sources import archives, folders, ranges, sinks, summaries, uploads
from ziplore.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]

MEMBER_LIMIT_MB = 1 / 64


# --- shared inputs --------------------------------------------------------


def described(spark, sf):
    """All files, triaged and analysed; unique per path once content is gone."""
    return validate.dedupe_members(plans.describe_files(corpus.files(spark, sf)))


def analysed(spark, sf):
    return triage.analysable(described(spark, sf))


def pinned(spark, sf):
    """For operators that read the results more than once."""
    return pin(described(spark, sf))


def paths_only(spark, sf):
    """Unique paths; content is pruned from the scan."""
    raw = corpus.files(spark, sf).select("project_id", "seq", "rel_path")
    return validate.dedupe_members(raw)


def path_columns(spark, sf):
    odd = corpus.odd_paths(spark, sf)
    return odd, paths.path_parts(F.col("path"))


def flat_artifacts(df: DataFrame) -> DataFrame:
    """Artefact rows with the summaries as text, one line per file."""
    lines = F.transform(
        "file_summaries",
        lambda r: F.concat_ws(
            " | ",
            r["rel_path"], r["kind"], r["summary"],
            r["lines"].cast("string"), r["size_bytes"].cast("string"),
            F.coalesce(r["language"], F.lit("-")),
        ),
    )
    return df.withColumn("file_summaries", F.array_join(lines, "\n")).select(
        "project_id", "part", "tree_text", "file_summaries", "project_summary"
    )


def results_from_table(spark, sf):
    return analysed(spark, sf).select(
        "project_id", "seq", "rel_path", "ext", "score", "kind", "summary", "lines", "size_bytes", "language"
    )


# --- sources and sinks ----------------------------------------------------


def src1(spark, sf):
    folder = corpus.archive_folder(spark, sf)
    return archives.scan_archives(spark, folder, 130_000 / archives.MB).select("project_id", "length")


def with_md5(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.md5("content").alias("content_md5"))


def src2(spark, sf):
    """Members read by ranges, several to an archive."""
    found = archives.list_archives(spark, corpus.archive_folder(spark, sf))
    members = ranges.explode_by_range(found.select("project_id", "path"), range_bytes=262_144)
    return with_md5(members, "project_id", "seq", "member_name", "rel_path", "size_bytes")


def src2_content(spark, sf):
    """Members of archives that come as rows, as on streams."""
    members = archives.explode_members(corpus.packed(spark, sf))
    return with_md5(members, "project_id", "seq", "member_name", "rel_path", "size_bytes")


def src3(spark, sf):
    rows = folders.scan_project_dirs(spark, corpus.project_folder(spark, sf))
    narrow = with_md5(rows, "project_id", "rel_path", "size_bytes")
    return triage.number_by_path(pin(narrow))


def src4(spark, sf):
    return with_md5(corpus.files(spark, sf), "project_id", "seq", "rel_path", "size_bytes")


def src5(spark, sf):
    return summaries.read_file_summaries(corpus.stored_summaries(spark, sf))


def snk1(spark, sf):
    out = scratch_path(spark, "artifacts")
    sinks.write_artifacts(plans.analyze_files(corpus.files(spark, sf)), out)
    return flat_artifacts(spark.read.schema(ARTIFACTS).json(out))


def snk2(spark, sf):
    out = scratch_path(spark, "file_summaries")
    sinks.write_file_summaries(triage.analysis_order(pinned(spark, sf)), out)
    return spark.read.parquet(out)


# --- validation -----------------------------------------------------------


def api1_verdicts(spark, sf):
    """One verdict for every upload of the folder."""
    folder = corpus.archive_folder(spark, sf, damage=True)
    found = plans.corpus_verdicts(spark, folder, max_archive_mb=0.125)
    return found.select(F.col("project_id").alias("archive"), "length", "reason")


def val1(spark, sf):
    folder = corpus.archive_folder(spark, sf, damage=True)
    listing = archives.list_archives(spark, folder)
    missing = corpus.files(spark, sf).select(
        F.concat(F.lit("missing_"), "project_id").alias("archive")
    ).distinct().withColumn("path", F.concat(F.lit(f"{folder}/"), "archive", F.lit(".zip")))
    asked = listing.select(F.col("project_id").alias("archive"), "path").unionByName(missing)
    checked = validate.validate_archives(asked, listing, max_mb=0.125)
    return checked.select("archive", "length", "reason", "is_valid")


def val2(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    sizes = docs.select("doc_id", (F.octet_length("text").cast("long") * 1000).alias("size"))
    return validate.size_limit(sizes, "size", limit_mb=5)


def val3(spark, sf):
    return validate.member_size_guard(corpus.members(spark, sf), MEMBER_LIMIT_MB)


def val4(spark, sf):
    return validate.zip_slip_guard(corpus.members(spark, sf))


def val5(spark, sf):
    return validate.extraction_status(corpus.members(spark, sf), MEMBER_LIMIT_MB)


def val6(spark, sf):
    pages, docs = corpus.table(spark, sf, "pages"), corpus.table(spark, sf, "documents")
    page, doc = F.col("page_id") % 4, F.col("doc_id") % 3
    url, source = F.col("url"), F.col("source")
    names = pages.select(
        F.lit("pages").alias("src"),
        F.col("page_id").alias("id"),
        F.when(page == 0, F.concat(url, F.lit(".zip")))
        .when(page == 1, F.concat(url, F.lit(".ZIP"))).otherwise(url).alias("name"),
    ).unionByName(
        docs.select(
            F.lit("documents").alias("src"),
            F.col("doc_id").alias("id"),
            F.when(doc == 0, F.concat(source, F.lit(".Zip"))).when(doc == 1, F.lit("")).alias("name"),
        )
    )
    return validate.accepted_uploads(names, "name")


def val7(spark, sf):
    return validate.check_file_results(corpus.result_records(spark, sf))


def val8(spark, sf):
    checked = validate.check_project_summary(corpus.summary_records(spark, sf))
    return checked.select(
        "doc_id", "project_name", F.length("description").cast("long").alias("description_chars"), "reject_reason"
    )


def val9(spark, sf):
    return validate.dedupe_members(with_md5(corpus.files(spark, sf), "project_id", "seq", "rel_path"))


def val10(spark, sf):
    return corpus.members(spark, sf).select(
        "project_id", "seq", "member_name", paths.stored_path(F.col("member_name")).alias("stored_path")
    )


# --- scalar functions -----------------------------------------------------


def fn1(spark, sf):
    odd, parts = path_columns(spark, sf)
    parts["parts"] = F.array_join(parts["parts"], " > ")
    return odd.select("src", "id", "path", *[c.alias(k) for k, c in parts.items()])


def fn2(spark, sf):
    return corpus.odd_bytes(spark, sf).select("doc_id", looks_binary(F.col("content")).alias("is_binary"))


def fn3(spark, sf):
    odd, parts = path_columns(spark, sf)
    return odd.select("src", "id", kinds.priority_score(parts["stem"], parts["ext"]).alias("score"))


def fn4(spark, sf):
    decoded = corpus.encodings(spark, sf).select("doc_id", text.decode_text(F.col("content")).alias("t"))
    return decoded.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


def fn5(spark, sf):
    return corpus.odd_texts(spark, sf).select("src", "id", text.summarise_text(F.col("text")).alias("summary"))


def of_column(table: str, key: str, column: str, function: Callable[[Column], Column]) -> Query:
    def run(spark, sf):
        return corpus.table(spark, sf, table).select(key, function(F.col(column)).alias("summary"))

    return run


def fn7(spark, sf):
    rows = corpus.yaml_texts(spark, sf)
    return rows.select("doc_id", parsers.yaml_key_summary(F.col("text")).alias("summary"))


def fn8(spark, sf):
    rows = corpus.python_texts(spark, sf)
    return rows.select("doc_id", parsers.python_summary(F.col("text")).alias("summary"))


def fn9(spark, sf):
    rows = results.with_text(triage.with_name_parts(corpus.files(spark, sf)))
    return results.analyse_files(rows).select("project_id", "seq", "rel_path", "kind", "summary")


def fn10(spark, sf):
    return corpus.odd_paths(spark, sf).select("src", "id", paths.normalise_path(F.col("path")).alias("path"))


def fn11(spark, sf):
    rows = results.with_metrics(triage.with_name_parts(corpus.files(spark, sf)))
    unique = validate.dedupe_members(rows.drop("content"))
    return unique.select("project_id", "seq", "lines", "size_bytes", "language")


def fn12(spark, sf):
    odd, parts = path_columns(spark, sf)
    return odd.select("src", "id", kinds.declared_kind(parts["ext"], parts["stem"]).alias("declared_kind"))


def fn13(spark, sf):
    return jobs.parse_messages(corpus.job_messages(spark, sf)).select("job_id", "event_id", "type", "body")


# --- triage ---------------------------------------------------------------


def tri1(spark, sf):
    rows = validate.dedupe_members(triage.triage(corpus.files(spark, sf)).drop("content"))
    return rows.select("project_id", "seq", "rel_path", "is_binary", "skip_reason", "score")


def triaged_narrow(spark, sf):
    """Triage columns only; pinned, because ranking reads them twice."""
    rows = validate.dedupe_members(triage.triage(corpus.files(spark, sf)).drop("content"))
    return rows.select("project_id", "seq", "rel_path", "ext", "skip_reason", "score")


def tri2(spark, sf):
    ranked = triage.analysis_order(pin(triaged_narrow(spark, sf)))
    return ranked.select("project_id", "seq", "rel_path", "score", "rank")


def tri3(spark, sf):
    top = triage.top_files(triaged_narrow(spark, sf), n=20)
    return top.select("project_id", "seq", "rel_path", "score", "rank")


def tri4(spark, sf):
    return triage.skip_counts(triaged_narrow(spark, sf))


# --- aggregates -----------------------------------------------------------


def paths_of_results(spark, sf):
    return triage.analysable(triaged_narrow(spark, sf))


def agg7(spark, sf):
    stats = project.project_stats(triage.analysable(pinned(spark, sf)))
    joined = {c: F.array_join(c, ", ") for c in ("languages", "frameworks", "key_components")}
    return stats.withColumns(joined)


def agg7_components(spark, sf):
    return project.project_components(analysed(spark, sf))


def agg5(spark, sf):
    return project.project_summary(triage.analysable(pinned(spark, sf)))


# --- tree -----------------------------------------------------------------


def tre1(spark, sf):
    return tree.tree_nodes(paths_only(spark, sf)).drop("first", "has_children")


def styled(style: str) -> Query:
    def run(spark, sf):
        return tree.tree_text(tree.tree_lines(paths_only(spark, sf), style)).drop("n_lines")

    return run


# --- joins, reports, events -----------------------------------------------


def jn1(spark, sf):
    narrow = pinned(spark, sf)
    drawn = tree.tree_text(tree.tree_lines(narrow.select("project_id", "seq", "rel_path")))
    parts = artifacts.summary_parts(triage.analysis_order(narrow))
    overview = project.project_summary(triage.analysable(narrow))
    return flat_artifacts(artifacts.assemble_artifacts(drawn, parts, overview))


def jn3(spark, sf):
    members = corpus.members(spark, sf)
    return validate.exclude_rejected(members, validate.extraction_status(members, MEMBER_LIMIT_MB))


def jn5(spark, sf):
    narrow = pinned(spark, sf)
    nodes = tree.tree_nodes(narrow.select("project_id", "seq", "rel_path")).drop("first", "has_children")
    return tree.attach_file_info(nodes, triage.analysable(narrow))


def rpt1(spark, sf):
    return reports.file_report(triage.analysable(pinned(spark, sf)), limit=25)


def rpt1_lines(spark, sf):
    ranked = triage.analysis_order(pinned(spark, sf))
    return reports.report_lines(ranked).select("project_id", "rank", "line")


def counted_events(log: DataFrame) -> DataFrame:
    return log.groupBy("project_id", "stage", "type").agg(F.count(F.lit(1)).alias("n"))


#: Largest member of archives in these runs, so that some extractions fail.
RUN_MEMBER_MB = 0.0234375


def set1(spark, sf):
    """The log of a run in which some results never came."""
    run = damaged_run(spark, sf)
    number = F.regexp_extract("project_id", r"(\d+)_\d+\z", 1).cast("long")
    lost = (number % 7 == 3) & (F.col("seq") % 10 == 7)
    validity, extraction = reports.split_verdicts(run.verdicts)
    log = reports.job_event_log(
        uploads=run.verdicts, validity=validity, extraction=extraction, triaged=run.files, results=run.results.filter(~lost),
        tree=run.lines, drafts=run.overview, polished=run.overview,
    )
    return counted_events(log)


def damaged_run(spark, sf):
    folder = corpus.archive_folder(spark, sf, damage=True)
    return plans.run_corpus(spark, folder, max_member_mb=RUN_MEMBER_MB)


def api1_events(spark, sf):
    return counted_events(damaged_run(spark, sf).events)


def api1_report(spark, sf):
    return damaged_run(spark, sf).report


# --- jobs -----------------------------------------------------------------


def status(spark, sf):
    return jobs.job_status(corpus.job_messages(spark, sf))


def named_jobs(spark, sf):
    return status(spark, sf).withColumn(
        "filename", F.concat(F.lit("upload_"), F.col("job_id").cast("string"), F.lit(".zip"))
    )


def job6(spark, sf):
    overview = agg5(spark, sf).select(
        F.substring("project_id", 4, 20).cast("long").alias("job_id"), "project_summary"
    )
    return jobs.job_result(status(spark, sf), overview).select("job_id", "status", "error", "project_summary")


# --- streams --------------------------------------------------------------


def run_stream(spark, df: DataFrame, mode: str) -> DataFrame:
    """Drain a stream into the shared folder and read back what it wrote."""
    out = scratch_path(spark, "stream")
    streams.drain(streams.write_updates(df, f"{out}/rows", f"{out}/progress", mode))
    written = spark.read.schema(df.schema).parquet(f"{out}/rows/batch=*")
    return written


def str1(spark, sf):
    folder = corpus.archive_folder(spark, sf)
    arriving = archives.stream_archives(spark, folder).select("project_id", "length")
    return run_stream(spark, arriving, "append")


def arriving_results(spark, sf):
    folder = corpus.archive_folder(spark, sf)
    return streams.stream_file_results(archives.stream_archives(spark, folder))


def str1_verdicts(spark, sf):
    """A verdict on each upload, from the stream of names."""
    folder, out = corpus.archive_folder(spark, sf, damage=True), scratch_path(spark, "stream")
    arriving = uploads.stream_uploads(spark, folder)
    streams.drain(streams.write_upload_verdicts(arriving, f"{out}/rows", f"{out}/progress", max_archive_mb=0.125))
    return spark.read.parquet(f"{out}/rows/batch=*").select(F.col("project_id").alias("archive"), "length", "reason")


def str2(spark, sf):
    rows = run_stream(spark, arriving_results(spark, sf), "append")
    return rows.drop("ext", "skip_reason")


def str3(spark, sf):
    """Counts kept in a table over micro-batches of a few archives each."""
    folder, out = corpus.archive_folder(spark, sf), scratch_path(spark, "stream")
    arriving = archives.stream_archives(spark, folder, max_files_per_trigger=max(1, len(corpus.uploads(spark, folder)) // 3))
    results = streams.stream_file_results(arriving)
    streams.drain(streams.write_project_counts(results, f"{out}/counts", f"{out}/progress"))
    return streams.project_counts_table(spark, f"{out}/counts").read().drop("last_batch")


def arriving_messages(spark, sf):
    """The events table as a stream of a few micro-batches in order of time."""
    folder = corpus.messages_in_cuts(spark, sf)
    schema = spark.read.parquet(f"{folder}/cut=0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/cut=*")


#: A job is silent too long after this, and the watermark stands so far behind the latest message.
SILENCE, DELAY = 86_400, "10 minutes"
#: For longer than the log is long, done and closed jobs are remembered.
REMEMBERED = 400 * 86_400


def str4(spark, sf):
    return run_stream(spark, streams.stream_job_completion(arriving_messages(spark, sf), None), "append")


def str5(spark, sf):
    out = scratch_path(spark, "stream")
    # The log spans more than a week, and closed jobs go on talking.
    writer = streams.write_job_messages(arriving_messages(spark, sf), f"{out}/rows", f"{out}/closes", f"{out}/progress", retention_seconds=REMEMBERED)
    streams.drain(writer)
    return spark.read.parquet(f"{out}/rows/batch=*").select("job_id", "event_id", "msg")


def str6(spark, sf):
    messages = pin(corpus.job_messages(spark, sf))
    now = messages.agg(F.max("ts") - F.expr(f"INTERVAL {DELAY}")).scalar()
    return jobs.job_completion(messages, SILENCE, now)


def str6_stream(spark, sf):
    """Completion with expiry: silent jobs are given out once the watermark has passed them."""
    completion = streams.stream_job_completion(arriving_messages(spark, sf), SILENCE, "event", DELAY, REMEMBERED)
    return run_stream(spark, completion, "append")


def str7(spark, sf):
    folder, out = corpus.archive_folder(spark, sf), scratch_path(spark, "stream")
    writer = streams.stream_artifacts(
        archives.stream_archives(spark, folder), f"{out}/rows", f"{out}/progress"
    )
    streams.drain(writer)
    return flat_artifacts(spark.read.parquet(f"{out}/rows"))


# --- enrichment, user functions, whole pipeline ---------------------------


def enr1(spark, sf):
    drafts = agg5(spark, sf).select("project_id", "project_summary")
    return enrich.polish_summaries(drafts)


def enr1_upper(spark, sf):
    def complete(messages_, model_id, temperature):
        project_id, _, draft = messages_[1]["content"].partition("\n")
        if project_id.endswith("5"):
            raise RuntimeError("no answer")
        return f"{project_id}\n{draft.upper()}"

    drafts = agg5(spark, sf).select(
        "project_id", F.concat_ws("\n", "project_id", "project_summary").alias("project_summary")
    )
    polished = enrich.polish_summaries(drafts, complete, "openai/any")
    return polished.withColumn("project_summary", F.regexp_replace("project_summary", r"(?s)\A[^\n]*\n", ""))


def udf1(spark, sf):
    def shell(body: str):
        return ("shell", f"Shell, {len(body)} characters") if len(body) % 2 == 0 else None

    rows = validate.dedupe_members(
        plans.describe_files(corpus.files(spark, sf), analyzers={".sh": shell})
    )
    return triage.analysable(rows).select("project_id", "seq", "kind", "summary")


def api1(spark, sf):
    return flat_artifacts(plans.analyze_files(corpus.files(spark, sf)))


def api1_archives(spark, sf):
    return flat_artifacts(plans.analyze_corpus(spark, corpus.archive_folder(spark, sf)))


def api1_flat(spark, sf):
    whole = plans.analyze_files(corpus.files(spark, sf), tree_style="flat")
    return whole.select("project_id", "part", "tree_text", "project_summary")


def on(source: Query, operator: Callable[..., DataFrame], *columns: str) -> Query:
    """A query that applies one operator to one input."""

    def run(spark, sf):
        out = operator(source(spark, sf))
        return out.select(*columns) if columns else out

    return run


def all_queries() -> dict[str, Query]:
    log = corpus.job_messages
    return {
        "src1": src1, "src2": src2, "src2_content": src2_content, "src3": src3, "src4": src4, "src5": src5, "snk1": snk1, "snk2": snk2,
        "val1": val1, "val2": val2, "val3": val3, "val4": val4, "val5": val5, "val6": val6, "val7": val7,
        "val8": val8, "val9": val9, "val10": val10,
        "fn1": fn1, "fn2": fn2, "fn3": fn3, "fn4": fn4, "fn5": fn5,
        "fn6": of_column("events", "event_id", "props", parsers.json_key_summary),
        "fn6_objects": of_column("events", "event_id", "props", parsers.object_key_summary),
        "fn7": fn7, "fn8": fn8, "fn9": fn9, "fn10": fn10, "fn11": fn11, "fn12": fn12, "fn13": fn13,
        "tri1": tri1, "tri2": tri2, "tri3": tri3, "tri4": tri4,
        "agg1": on(paths_of_results, project.stack_flags),
        "agg2": on(paths_of_results, project.guess_stack),
        "agg3": on(analysed, project.dominant_kind),
        "agg4": on(analysed, project.readme_line),
        "agg5": agg5,
        "agg6": on(analysed, project.kind_counts),
        "agg7": agg7, "agg7_components": agg7_components,
        "agg8": on(results_from_table, project.corpus_stats),
        "tre1": tre1,
        "tre2": on(paths_only, tree.tree_order),
        "tre2_files": on(paths_only, tree.file_order, "project_id", "seq", "rel_path", "ord"),
        "tre3": styled("guides"),
        "tre3_lines": on(paths_only, tree.tree_lines),
        "tre4": styled("flat"), "tre5": styled("grouped"),
        "jn1": jn1, "jn3": jn3, "jn5": jn5,
        "rpt1": rpt1, "rpt1_lines": rpt1_lines, "set1": set1, "api1_events": api1_events, "api1_report": api1_report,
        "job1": on(log, jobs.events_until_close, "job_id", "event_id", "msg"),
        "job2": on(log, jobs.job_progress, "job_id", "event_id", "progress"),
        "job3": on(log, jobs.job_status, "job_id", "status", "error", "latest_stage"),
        "job4": on(status, jobs.job_durations),
        "job5": on(named_jobs, jobs.job_listing),
        "job5_counts": on(status, jobs.job_counts),
        "job6": job6,
        "str1": str1, "str1_verdicts": str1_verdicts, "str2": str2, "str3": str3, "str4": str4, "str5": str5, "str6": str6, "str6_stream": str6_stream, "str7": str7,
        "enr1": enr1, "enr1_upper": enr1_upper, "udf1": udf1,
        "api1": api1, "api1_archives": api1_archives, "api1_verdicts": api1_verdicts, "api1_flat": api1_flat,
    }
