"""Triage: tell binary from text, score files and put them in analysis order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ziplore.functions.binary import looks_binary
from ziplore.functions.kinds import is_asset, priority_score
from ziplore.functions.paths import base_name, extension_of, stem_of
from ziplore.operators.ranking import rank_by_slices, top_per_key

SKIP_REASON = "binary/asset"


def with_name_parts(files: DataFrame) -> DataFrame:
    """Add ``name``, ``stem`` and ``ext``."""
    name = base_name(F.col("rel_path"))
    return files.withColumn("name", name).withColumns(
        {"stem": stem_of(F.col("name")), "ext": extension_of(F.col("name"))}
    )


def triage(files: DataFrame) -> DataFrame:
    """Add ``is_binary``, ``skip_reason`` (null when analysable) and ``score``.

    A skipped file has no score.
    """
    named = with_name_parts(files).withColumn("is_binary", looks_binary(F.col("content")))
    skipped = F.col("is_binary") | is_asset(F.col("ext"))
    return named.withColumns(
        {
            "skip_reason": F.when(skipped, F.lit(SKIP_REASON)),
            "score": F.when(~skipped, priority_score(F.col("stem"), F.col("ext"))),
        }
    )


def analysable(triaged: DataFrame) -> DataFrame:
    return triaged.filter(F.col("skip_reason").isNull())


def skipped_files(triaged: DataFrame) -> DataFrame:
    return triaged.filter(F.col("skip_reason").isNotNull())


def skip_counts(triaged: DataFrame) -> DataFrame:
    """Skipped files per project, reason and extension."""
    grouped = skipped_files(triaged).groupBy("project_id", F.col("skip_reason").alias("reason"), "ext")
    return grouped.agg(F.count(F.lit(1)).alias("n"))


def analysis_order(triaged: DataFrame) -> DataFrame:
    """Add ``rank``: per project, score descending, then discovery order, which may be any 64-bit ``seq``.

    Pass pinned narrow rows: the frame is read for the counts and for the ranks,
    and content should not take part in either.
    """
    return rank_by_slices(analysable(triaged), ["project_id"], [-F.col("score"), "seq"], out="rank")


def top_files(triaged: DataFrame, n: int = 500) -> DataFrame:
    """The ``n`` files of each project that come first in analysis order."""
    order = [F.desc("score"), F.asc("seq")]
    return top_per_key(analysable(triaged), ["project_id"], order, "seq", n, out="rank")


def number_by_path(files: DataFrame) -> DataFrame:
    """Add ``seq`` in path order for files that came without a member index; pass pinned narrow rows."""
    ranked = rank_by_slices(files, ["project_id"], ["rel_path"], out="seq")
    return ranked.withColumn("seq", F.col("seq") - 1)
