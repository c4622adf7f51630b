"""Guards on uploads, members and result records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ziplore.functions.paths import escapes_root, normalise_path, upload_name_accepted
from ziplore.functions.text import MODEL_BLANKS, strip
from ziplore.operators.joins import count_keys, join_measured
from ziplore.schemas import FILE_KINDS
from ziplore.sources.archives import MAX_ARCHIVE_MB, MAX_MEMBER_MB, MB, NOT_THERE, OUTSIDE_ROOT, archive_faults
from ziplore.sources.ranges import range_faults

SUMMARY_LIMIT = 500
DESCRIPTION_LIMIT = 1000
NOTES_LIMIT = 2000


def validate_archives(
    uploads: DataFrame, listing: DataFrame, contents: DataFrame | None = None, max_mb: float = MAX_ARCHIVE_MB
) -> DataFrame:
    """First failing reason per upload; null when valid.

    ``uploads(path)`` are the requested archives and ``listing(path, length)``
    those that exist. Only archives that are asked for and within the limit are
    opened, by ranges of members. ``contents(path, content)`` is for stores that
    tasks can't open on their own: a scan that already leaves out oversized
    archives, all of which are checked where they are read.
    """
    limit = int(max_mb * MB)
    if contents is None:
        asked = listing.filter(F.col("length") <= limit).join(uploads.select("path").distinct(), "path", "left_semi")
        faults = range_faults(asked.select(F.col("path").alias("project_id"), "path"), max_member_mb=None)
    else:
        faults = archive_faults(contents.select(F.col("path").alias("project_id"), "content"), max_member_mb=None)
    verdicts = faults.select(F.col("project_id").alias("path"), "reject_reason")
    reason = (
        F.when(F.col("length").isNull(), F.lit(NOT_THERE))
        .when(F.col("length") > limit, F.lit(f"Archive exceeds {max_mb:g} MB"))
        .otherwise(F.col("reject_reason"))
    )
    return (
        uploads.join(listing.select("path", "length"), "path", "left")
        .join(verdicts, "path", "left")
        .withColumn("reason", reason)
        .withColumn("is_valid", F.col("reason").isNull())
        .drop("reject_reason")
    )


def size_limit(df: DataFrame, size_col: str, limit_mb: float) -> DataFrame:
    """Flag rows strictly above the limit, with the actual size in MB."""
    megabytes = F.bround(F.col(size_col) / MB, 1)
    over = F.col(size_col) > int(limit_mb * MB)
    text = F.concat(
        F.lit(f"Archive exceeds {limit_mb:g} MB ("), F.format_string("%.1f", megabytes), F.lit(" MB)")
    )
    return df.withColumn("too_large", over).withColumn("size_error", F.when(over, text))


def _without_faulty(members: DataFrame, fault: Column) -> DataFrame:
    """Rows of projects without a faulty member; sizes of projects and their faults come from one grouping."""
    facts = members.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(fault).alias("_faulty"))
    faulty = facts.filter("_faulty").select("project_id")
    return join_measured(members, faulty, ["project_id"], "seq", "left_anti", counts=facts)


def member_size_guard(members: DataFrame, max_mb: float = MAX_MEMBER_MB) -> DataFrame:
    """Drop every row of a project that has a member above the limit."""
    return _without_faulty(members, F.col("size_bytes") > int(max_mb * MB))


def zip_slip_guard(members: DataFrame) -> DataFrame:
    """Drop every row of a project that has a member outside its root."""
    return _without_faulty(members, escapes_root(F.col("member_name")))


def member_fault(max_mb: float = MAX_MEMBER_MB) -> Column:
    """Reason a member is not acceptable; size comes before path."""
    name = F.col("member_name")
    return F.when(
        F.col("size_bytes") > int(max_mb * MB),
        F.concat(F.lit("Member "), name, F.lit(f" exceeds {max_mb:g} MB")),
    ).when(escapes_root(name), F.concat(F.lit(OUTSIDE_ROOT), name))


def extraction_status(members: DataFrame, max_mb: float = MAX_MEMBER_MB) -> DataFrame:
    """Per project: null, or the reason of its first bad member in member order."""
    fault = member_fault(max_mb)
    return (
        members.select("project_id", "seq", fault.alias("fault"))
        .groupBy("project_id")
        .agg(F.expr("min_by(fault, seq) FILTER (WHERE fault IS NOT NULL)").alias("reason"))
        .withColumn("is_valid", F.col("reason").isNull())
    )


def exclude_rejected(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Rows of projects that were not turned away."""
    rejected = status.filter(F.col("reason").isNotNull()).select("project_id").distinct()
    return join_measured(rows, rejected, ["project_id"], "seq", "left_anti", counts=count_keys(rows, ["project_id"]))


def accepted_uploads(df: DataFrame, name_col: str) -> DataFrame:
    """Uploads whose name ends in ``.zip``, in any case."""
    return df.filter(upload_name_accepted(F.col(name_col)))


def dedupe_members(members: DataFrame) -> DataFrame:
    """Of members that land on one path the last one wins.

    Spark limits each task's share of a path to one row before the shuffle, so
    a path with very many copies does not pile up.
    """
    latest = Window.partitionBy("project_id", "rel_path").orderBy(F.desc("seq"))
    return members.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def clean_result(r: Column) -> Column:
    """A file result with stripped strings and forward slashes."""
    return F.struct(
        normalise_path(strip(r["rel_path"], MODEL_BLANKS)).alias("rel_path"),
        r["kind"].alias("kind"),
        strip(r["summary"], MODEL_BLANKS).alias("summary"),
        r["lines"].alias("lines"),
        r["size_bytes"].alias("size_bytes"),
        strip(r["language"], MODEL_BLANKS).alias("language"),
    )


def result_fault(r: Column) -> Column:
    """First rule a file result breaks, or null. Lengths are code points."""

    def broken(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(True))

    return (
        F.when(broken(strip(r["rel_path"], MODEL_BLANKS) == ""), "rel_path is empty")
        .when(broken(~r["kind"].isin(*FILE_KINDS)), "kind is not known")
        .when(
            broken(F.length(strip(r["summary"], MODEL_BLANKS)) > SUMMARY_LIMIT),
            f"summary exceeds {SUMMARY_LIMIT} characters",
        )
        .when(broken(r["lines"] < 0), "lines is negative")
        .when(broken(r["size_bytes"] < 0), "size_bytes is negative")
    )


def check_file_results(df: DataFrame) -> DataFrame:
    """Cleaned result columns plus ``reject_reason`` (null when acceptable)."""
    fields = ("rel_path", "kind", "summary", "lines", "size_bytes", "language")
    raw = F.struct(*[F.col(f) for f in fields])
    others = [c for c in df.columns if c not in fields]
    return df.select(
        *others, clean_result(raw).alias("_r"), result_fault(raw).alias("reject_reason")
    ).select(*others, *[F.col(f"_r.{f}") for f in fields], "reject_reason")


def check_project_summary(df: DataFrame) -> DataFrame:
    """Project summaries plus ``reject_reason``; strings are taken as they are."""

    def too_long(name: str, limit: int) -> Column:
        return F.coalesce(F.length(name) > limit, F.lit(True))

    def negative(name: str) -> Column:
        return F.coalesce(F.col(name) < 0, F.lit(True))

    reason = (
        F.when(F.coalesce(F.col("project_name") == "", F.lit(True)), "project_name is empty")
        .when(
            too_long("description", DESCRIPTION_LIMIT),
            f"description exceeds {DESCRIPTION_LIMIT} characters",
        )
        .when(
            too_long("architecture_notes", NOTES_LIMIT),
            f"architecture_notes exceeds {NOTES_LIMIT} characters",
        )
        .when(negative("file_count"), "file_count is negative")
        .when(negative("line_count"), "line_count is negative")
    )
    return df.withColumn("reject_reason", reason)


def split_checked(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejected rows of a checked frame."""
    accepted = df.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, df.filter(F.col("reject_reason").isNotNull())
