"""Report views and the typed event table of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ziplore.operators.ranking import top_per_key

REPORT_ROWS = 50
REPORT_WIDTH = 100


def file_report(
    results: DataFrame, limit: int = REPORT_ROWS, width: int = REPORT_WIDTH
) -> DataFrame:
    """The first ``limit`` files per project and a row that counts the rest."""
    order = [F.desc("score"), F.asc("seq")]
    shown = top_per_key(results, ["project_id"], order, "seq", limit, out="row_no").select(
        "project_id",
        "row_no",
        F.col("rel_path").alias("path"),
        "kind",
        F.col("lines").cast("string").alias("lines"),
        F.substring("summary", 1, width).alias("summary"),
    )
    rest = (
        results.groupBy("project_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > limit)
        .select(
            "project_id",
            F.lit(limit + 1).cast("long").alias("row_no"),
            F.lit("...").alias("path"),
            F.concat(F.lit("+"), (F.col("n") - limit).cast("string"), F.lit(" more")).alias("kind"),
            F.lit("...").alias("lines"),
            F.lit("").alias("summary"),
        )
    )
    return shown.unionByName(rest)


def report_lines(results: DataFrame) -> DataFrame:
    """``path (kind) – summary`` for every file."""
    line = F.concat(
        F.col("rel_path"), F.lit(" ("), F.col("kind"), F.lit(") – "), F.coalesce("summary", F.lit(""))
    )
    return results.withColumn("line", line)


# Types of events, with the number of their stage in a run.
EVENT_STAGES = {
    "NewUpload": 0,
    "ZipValid": 1,
    "ZipInvalid": 1,
    "ExtractionFailed": 2,
    "FileDiscovered": 3,
    "ExtractionDone": 4,
    "FileSkipped": 5,
    "FileForAnalysis": 6,
    "TriageComplete": 7,
    "FileAnalysed": 8,
    "AnalysisComplete": 9,
    "TreeBuilt": 10,
    "ProjectDraft": 11,
    "SummaryPolished": 12,
}


def _events(df: DataFrame, event_type: str, **payload: Column) -> DataFrame:
    entries = [x for name, value in payload.items() for x in (F.lit(name), value.cast("string"))]
    body = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return df.select(
        "project_id",
        F.lit(EVENT_STAGES[event_type]).alias("stage"),
        F.lit(event_type).alias("type"),
        body.cast("map<string,string>").alias("payload"),
    )


# Why an archive is turned away when members are extracted; other reasons are the validator's.
EXTRACTION_REASONS = r"^(Member .* exceeds [^ ]+ MB|Illegal member path: .*)$"


def split_verdicts(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(validity, extraction)`` of ``(project_id, reason)``: who turned an archive away.

    An archive that is not valid is not extracted. One with an oversized member
    or a member outside the root is valid, and its extraction fails.
    """
    by_extraction = F.coalesce(F.col("reason").rlike(f"(?s){EXTRACTION_REASONS}"), F.lit(False))
    validity = verdicts.withColumn("reason", F.when(~by_extraction, F.col("reason")))
    extraction = verdicts.filter(F.col("reason").isNull() | by_extraction)
    return validity, extraction


def reached_barriers(extracted: DataFrame, files: DataFrame, results: DataFrame, tree: DataFrame) -> DataFrame:
    """Per extracted project, which of its barriers hold: ``triaged, analysed, has_tree``.

    Counted from what is there: triage is complete when every discovered file
    has been scored or skipped, analysis when every scored file has a result,
    and the tree is built when it has a line.
    """
    seen = files.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("_files"),
        F.count(F.coalesce("skip_reason", F.col("score").cast("string"))).alias("_triaged"),
        F.count(F.when(F.col("skip_reason").isNull() & F.col("score").isNotNull(), 1)).alias("_scored"),
    )
    found = results.groupBy("project_id").agg(F.count(F.lit(1)).alias("_results"))
    drawn = tree.groupBy("project_id").agg(F.lit(True).alias("has_tree"))
    facts = extracted.select("project_id")
    for side in (seen, found, drawn):
        facts = facts.join(side, "project_id", "left")
    n = {name: F.coalesce(name, F.lit(0)) for name in ("_files", "_triaged", "_scored", "_results")}
    triaged = n["_files"] == n["_triaged"]
    return facts.select(
        "project_id",
        triaged.alias("triaged"),
        (triaged & (n["_scored"] == n["_results"])).alias("analysed"),
        F.coalesce("has_tree", F.lit(False)).alias("has_tree"),
    )


def job_event_log(
    uploads: DataFrame,
    validity: DataFrame,
    extraction: DataFrame,
    triaged: DataFrame,
    results: DataFrame,
    tree: DataFrame,
    drafts: DataFrame,
    polished: DataFrame,
) -> DataFrame:
    """All stage outputs as one table ``project_id, stage, type, payload``.

    ``validity`` has a ``reason`` (null when fine) per upload and ``extraction`` per
    valid one, ``triaged`` has ``skip_reason`` and ``score`` per file, ``tree`` the
    lines of each tree and ``polished`` the final overview per project. Barrier
    events stand only where the rows of their stage say so
    (:func:`reached_barriers`); a project without its tree and its whole
    analysis has no draft.
    """
    reason, path = F.col("reason"), F.col("rel_path")
    extracted = extraction.filter(reason.isNull())
    kept = triaged.filter(F.col("skip_reason").isNull() & F.col("score").isNotNull())
    barriers = reached_barriers(extracted, triaged, results, tree)
    finished = barriers.filter("analysed AND has_tree").select("project_id")
    tables = [
        _events(uploads, "NewUpload"),
        _events(validity.filter(reason.isNull()), "ZipValid"),
        _events(validity.filter(reason.isNotNull()), "ZipInvalid", reason=reason),
        _events(extraction.filter(reason.isNotNull()), "ExtractionFailed", reason=reason),
        _events(triaged, "FileDiscovered", path=path),
        _events(extracted, "ExtractionDone"),
        _events(
            triaged.filter(F.col("skip_reason").isNotNull()),
            "FileSkipped",
            path=path,
            reason=F.col("skip_reason"),
        ),
        _events(kept, "FileForAnalysis", path=path, score=F.col("score")),
        _events(barriers.filter("triaged"), "TriageComplete"),
        _events(
            results, "FileAnalysed", rel_path=path, kind=F.col("kind"), summary=F.col("summary")
        ),
        _events(barriers.filter("analysed"), "AnalysisComplete"),
        _events(barriers.filter("has_tree"), "TreeBuilt"),
        _events(drafts.join(finished, "project_id", "left_semi"), "ProjectDraft", draft=F.col("project_summary")),
        _events(polished.join(finished, "project_id", "left_semi"), "SummaryPolished", summary=F.col("project_summary")),
    ]
    log = tables[0]
    for table in tables[1:]:
        log = log.unionByName(table)
    return log
