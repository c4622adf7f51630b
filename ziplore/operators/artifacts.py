"""Final artefacts of a project: tree text, file summaries and overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ziplore.schemas import ARTIFACTS, FILE_RESULT

FILES_PER_PART = 10_000


def _result_struct() -> Column:
    return F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FILE_RESULT])


def summary_parts(ranked: DataFrame, files_per_part: int = FILES_PER_PART) -> DataFrame:
    """Results in analysis order as arrays of at most ``files_per_part`` each."""
    part = F.floor((F.col("rank") - 1) / files_per_part).alias("part")
    ordered = F.array_sort(F.collect_list(F.struct("rank", _result_struct().alias("r"))))
    return ranked.groupBy("project_id", part).agg(
        F.transform(ordered, lambda x: x["r"]).alias("file_summaries")
    )


def last_parts(rows: DataFrame, number: Column, per_part: int) -> DataFrame:
    """``project_id, last``: the last part of each project, from rows numbered from 0."""
    return rows.groupBy("project_id").agg(F.floor(F.max(number) / per_part).alias("last"))


def assemble_artifacts(
    tree: DataFrame, summaries: DataFrame, overview: DataFrame, parts: DataFrame | None = None
) -> DataFrame:
    """Join tree parts, summary parts and overview into artefact rows.

    A project is finished when it has a non-empty tree and an overview, which
    exists once its analysis is complete; other projects give no row. An
    ordinary project is one row. Where the tree or the summaries need more
    parts, part *n* of both share a row; the overview is on each.

    The overview is laid out over the parts first, so that all wide rows are
    joined on ``(project_id, part)`` and a large project stays spread out.
    ``parts`` has the ``last`` part of each project with a tree, counted on narrow
    rows; without it trees and summaries are planned once more to be counted.
    """
    if parts is None:
        both = tree.select("project_id", "part", F.lit(True).alias("_tree")).unionByName(
            summaries.select("project_id", "part", F.lit(False).alias("_tree"))
        )
        parts = both.groupBy("project_id").agg(F.max("part").alias("last"), F.bool_or("_tree").alias("_tree")).filter("_tree")
    slots = (
        overview.select("project_id", "project_summary")
        .join(parts.select("project_id", "last"), "project_id")
        .select("project_id", "project_summary", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part"))
    )
    none = F.array().cast(ARTIFACTS["file_summaries"].dataType)
    text = F.coalesce("tree_text", F.lit(""))
    return (
        slots.join(tree.select("project_id", "part", "tree_text"), ["project_id", "part"], "left")
        .join(summaries, ["project_id", "part"], "left")
        .filter((F.col("part") > 0) | (text != ""))
        .select(
            "project_id",
            "part",
            text.alias("tree_text"),
            F.coalesce("file_summaries", none).alias("file_summaries"),
            "project_summary",
        )
    )
