"""The whole analysis as one plan over a corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ziplore.operators.artifacts import FILES_PER_PART, assemble_artifacts, last_parts, summary_parts
from ziplore.operators.enrich import polish_summaries
from ziplore.operators.joins import anti_join
from ziplore.operators.project import project_summary
from ziplore.operators.reports import file_report, job_event_log, split_verdicts
from ziplore.operators.results import analyse_files, with_metrics, with_text
from ziplore.operators.tree import LINES_PER_PART, tree_lines, tree_text
from ziplore.operators.triage import analysable, analysis_order, number_by_path, top_files, triage
from ziplore.operators.validate import dedupe_members
from ziplore.session import configure, pin
from ziplore.sources.archives import (
    MAX_ARCHIVE_MB,
    MAX_MEMBER_MB,
    MB,
    NOT_A_ZIP,
    archive_faults,
    list_archives,
    open_archives,
    scan_archives,
)
from ziplore.sources.folders import list_uploads, scan_project_dirs
from ziplore.sources.ranges import first_faults, plan_ranges, range_faults, read_ranges
from ziplore.sources.storage import qualified, streamable

NARROW = [
    "project_id", "seq", "rel_path", "ext", "skip_reason", "score",
    "kind", "summary", "lines", "size_bytes", "language",
]


def describe_files(
    files: DataFrame, analyzers: dict[str, Callable] | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Triage and analyse every file and let go of its content.

    The one stage that touches bytes: no shuffle, one read. Skipped files keep
    their row, with ``skip_reason`` set and no kind or summary; their text is
    not decoded and not sent to Python.
    """
    analysed = F.col("skip_reason").isNull()
    rows = with_metrics(triage(files)).withColumn("content", F.when(analysed, F.col("content")))
    described = analyse_files(with_text(rows), analyzers).withColumns(
        {name: F.when(analysed, F.col(name)) for name in ("kind", "summary")}
    )
    return described.select(*[c for c in NARROW if c in described.columns], *keep)


@dataclass
class Run:
    """What one run over archives or files gives; frames over pinned rows.

    ``verdicts`` say per archive why it was turned away (null when it was
    analysed), ``events`` is the typed log of all stages, counted from what is
    there, and ``report`` the first files of each project.
    """

    artifacts: DataFrame
    verdicts: DataFrame
    files: DataFrame
    results: DataFrame
    lines: DataFrame
    overview: DataFrame

    @property
    def events(self) -> DataFrame:
        validity, extraction = split_verdicts(self.verdicts)
        drafts = self.overview.select("project_id", F.col("draft").alias("project_summary"))
        return job_event_log(
            self.verdicts, validity, extraction, self.files, self.results, self.lines, drafts, self.overview
        )

    @property
    def report(self) -> DataFrame:
        return file_report(self.results)


def _run(
    narrow: DataFrame,
    projects: DataFrame,
    verdicts: DataFrame,
    top_n: int | None,
    tree_style: str,
    complete_fn: Callable | None,
    model_id: str,
) -> Run:
    """Artefacts and what they are made of, from pinned narrow rows."""
    ranked = top_files(narrow, top_n) if top_n else analysis_order(narrow)
    results = ranked if top_n else analysable(narrow)
    draft = project_summary(results, projects).select("project_id", "project_summary")
    overview = polish_summaries(draft.withColumn("draft", F.col("project_summary")), complete_fn, model_id)
    lines = pin(tree_lines(narrow.select("project_id", "seq", "rel_path"), tree_style, projects).select("project_id", "line_no", "line"))
    # Every line of a tree and every result counts, so parts need no second plan.
    n_lines = last_parts(lines, F.col("line_no"), LINES_PER_PART)
    n_files = results.groupBy("project_id").agg(F.floor((F.count(F.lit(1)) - 1) / FILES_PER_PART).alias("_files"))
    parts = n_lines.join(n_files, "project_id", "left").select("project_id", F.greatest("last", "_files").alias("last"))
    artifacts = assemble_artifacts(tree_text(lines), summary_parts(ranked), overview, parts)
    return Run(artifacts, verdicts, narrow, results, lines, overview)


def analyze_files(
    files: DataFrame,
    *,
    projects: DataFrame | None = None,
    top_n: int | None = None,
    tree_style: str = "guides",
    analyzers: dict[str, Callable] | None = None,
    complete_fn: Callable | None = None,
    model_id: str = "ollama/llama3",
    dedupe: bool = True,
) -> DataFrame:
    """Artefacts for any frame of the ``files`` model.

    The narrow results are pinned once; ranks, tree and overview read that
    copy, so content is scanned and parsed once. Of files on one path the last
    one counts; ``dedupe`` sorts that out on narrow rows, after content is
    gone, and may be off when paths are known to be unique.
    """
    configure(files.sparkSession)
    narrow = describe_files(files, analyzers)
    if "seq" not in files.columns:
        # Pinned first: numbering reads its input more than once.
        narrow = number_by_path(pin(narrow))
    elif dedupe:
        narrow = dedupe_members(narrow)
    narrow = pin(narrow)
    listed = narrow.select("project_id").distinct() if projects is None else projects
    verdicts = listed.select("project_id", F.lit(None).cast("string").alias("reason"))
    return _run(narrow, listed, verdicts, top_n, tree_style, complete_fn, model_id).artifacts


def run_archives(
    archives: DataFrame,
    *,
    max_member_mb: float = MAX_MEMBER_MB,
    top_n: int | None = None,
    tree_style: str = "guides",
    analyzers: dict[str, Callable] | None = None,
    complete_fn: Callable | None = None,
    model_id: str = "ollama/llama3",
) -> Run:
    """A run over a frame of archives, ``(project_id, path)`` or ``(project_id, content)``.

    Unsound archives give no artefact. With paths, archives are read by ranges
    of members (:mod:`ziplore.sources.ranges`). Members are read once and
    described in the task that unpacks them; the marker rows travel along to
    name the projects, also those without files. What was read of an archive
    before a fault was found is dropped afterwards, on narrow rows.
    """
    configure(archives.sparkSession)
    if "content" in archives.columns:
        opened = open_archives(archives, max_member_mb)
    else:
        opened = read_ranges(plan_ranges(archives, max_member_mb), max_member_mb)
    marker, fine = F.col("seq").isNull(), F.col("reject_reason").isNull()
    narrow = pin(describe_opened(opened, analyzers))
    verdicts = narrow.filter(marker).select("project_id", F.col("reject_reason").alias("reason"))
    members = narrow.filter(~marker & fine).drop("reject_reason")
    late = narrow.filter(~marker & ~fine)
    if not late.isEmpty():
        faults = first_faults(late).withColumnRenamed("reject_reason", "_late")
        verdicts = verdicts.join(faults, "project_id", "left").select("project_id", F.coalesce("reason", "_late").alias("reason"))
        members = anti_join(members, late.select("project_id"), ["project_id"], "seq")
    sound = verdicts.filter(F.col("reason").isNull()).select("project_id")
    return _run(members, sound, verdicts, top_n, tree_style, complete_fn, model_id)


def analyze_archives(archives: DataFrame, **options) -> DataFrame:
    """Artefacts of :func:`run_archives`."""
    return run_archives(archives, **options).artifacts


def describe_opened(opened: DataFrame, analyzers: dict[str, Callable] | None = None) -> DataFrame:
    """:func:`describe_files` for opened archives, keeping their marker rows."""
    return describe_files(opened, analyzers, keep=("reject_reason",))


def run_corpus(spark: SparkSession, path: str, *, max_archive_mb: float = MAX_ARCHIVE_MB, **options) -> Run:
    """A run over every archive below ``path`` within the size limit.

    Where tasks can open the store on their own, archives are read by ranges;
    else Spark's source reads them whole.
    """
    if not streamable(qualified(spark, path)):
        return run_archives(scan_archives(spark, path, max_archive_mb), **options)
    listed = list_archives(spark, path).filter(F.col("length") <= int(max_archive_mb * MB))
    return run_archives(listed.select("project_id", "path"), **options)


def analyze_corpus(spark: SparkSession, path: str, **options) -> DataFrame:
    """Artefacts for every sound archive below ``path``; takes the options of :func:`run_corpus`."""
    return run_corpus(spark, path, **options).artifacts


def upload_verdicts(uploads: DataFrame, max_archive_mb: float = MAX_ARCHIVE_MB, max_member_mb: float = MAX_MEMBER_MB) -> DataFrame:
    """``project_id, path, length, reason`` of pinned listed uploads, null when an upload is analysed."""
    limit = int(max_archive_mb * MB)
    readable = uploads.filter((F.col("length") > 0) & (F.col("length") <= limit))
    faults = range_faults(readable.select(F.col("path").alias("project_id"), "path"), max_member_mb)
    return _verdicts(uploads, faults, max_archive_mb)


def _verdicts(uploads: DataFrame, faults: DataFrame, max_archive_mb: float) -> DataFrame:
    """Reasons from sizes and names, and from ``faults``, whose ``project_id`` is a path."""
    hidden = F.substring_index("path", "/", -1).rlike("^[_.]")
    reason = (
        F.when(F.col("length") > int(max_archive_mb * MB), F.lit(f"Archive exceeds {max_archive_mb:g} MB"))
        .when(F.col("length") == 0, F.lit(NOT_A_ZIP))
        .when(hidden, F.lit("Name is hidden from file sources"))
        .otherwise(F.col("reject_reason"))
    )
    joined = uploads.join(faults.withColumnRenamed("project_id", "path"), "path", "left")
    return joined.select("project_id", "path", "length", reason.alias("reason"))


def corpus_verdicts(
    spark: SparkSession,
    path: str,
    *,
    max_archive_mb: float = MAX_ARCHIVE_MB,
    max_member_mb: float = MAX_MEMBER_MB,
) -> DataFrame:
    """One row per upload below ``path``: ``project_id, path, length, reason``, null when it is analysed.

    The other half of :func:`analyze_corpus`: verdicts without a reason and
    artefacts are the same projects.
    """
    if streamable(qualified(spark, path)):
        return upload_verdicts(pin(list_uploads(spark, path)), max_archive_mb, max_member_mb)
    # Zero bytes and hidden names can't be seen there.
    opened = scan_archives(spark, path, max_archive_mb).select(F.col("path").alias("project_id"), "content")
    return _verdicts(list_archives(spark, path), archive_faults(opened, max_member_mb), max_archive_mb)


def analyze_project_dirs(spark: SparkSession, root: str, **options) -> DataFrame:
    """Artefacts for every unpacked project below ``root``."""
    return analyze_files(scan_project_dirs(spark, root), **options)
