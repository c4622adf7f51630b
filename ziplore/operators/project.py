"""Per-project and corpus aggregates.

All of them are groupings with a partial step before the shuffle, so a project
with very many files reaches its final task as one row per input task. "First"
always means analysis order; it is taken as the smallest position number, so
no rank is needed and the large groupings stay hash aggregates.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ziplore.functions.kinds import STACK_MARKERS, UNKNOWN_STACK, has_marker
from ziplore.functions.text import ELLIPSIS, strip_right
from ziplore.operators.ranking import top_per_key
from ziplore.sources.archives import project_label

# The sentences of an overview, and where it is cut.
KIND_SENTENCE = "The dominant file type is *{kind}* (count: {count})."
STACK_SENTENCE = "Inferred tech stack: {stack}."
DOCKERFILE_SENTENCE = "Presence of a Dockerfile suggests containerized deployment."
PACKAGING_SENTENCE = "Packaging metadata indicates a Python package."
NODE_SENTENCE = "Including 'package.json' reveals a Node.js component."
SUMMARY_LIMIT = 300

# Named components of a project, and characters of its notes.
TOP_COMPONENTS = 50
NOTES_CHARS = 2000

# Column that holds the flag of each stack label.
FLAG_COLUMNS = {
    "Python package": "has_packaging",
    "Node.js project": "has_package_json",
    "Containerized service": "has_dockerfile",
    "Go module": "has_go_mod",
    "Java Maven project": "has_pom",
}


def _filled(sentence: str, **values: Column) -> Column:
    """A sentence with its places filled in."""
    parts = re.split(r"\{(\w+)\}", sentence)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def _position() -> Column:
    """Analysis order as one number: score descending, then ``seq``.

    A number of fixed size keeps the grouping a hash aggregate, which a struct
    would not. Any ``seq`` of 64 bits fits between two scores, negative ones too.
    """
    step = F.lit(Decimal(10**20))
    return (100 - F.col("score")).cast("decimal(10,0)") * step + F.col("seq").cast("decimal(19,0)")


def _per_project(grouped: DataFrame, projects: DataFrame | None) -> DataFrame:
    """Start from the project list, so that projects without files are kept."""
    if projects is None:
        return grouped
    return projects.select("project_id").distinct().join(grouped, "project_id", "left")


def _flag_aggregates() -> list[Column]:
    return [
        F.bool_or(has_marker(F.col("rel_path"), label)).alias(column)
        for label, column in FLAG_COLUMNS.items()
    ]


def stack_flags(results: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Which stack markers each project has. Endings count, not whole names."""
    grouped = results.groupBy("project_id").agg(*_flag_aggregates())
    return _per_project(grouped, projects).select(
        "project_id", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in FLAG_COLUMNS.values()]
    )


def stack_label() -> Column:
    """The first stack in order of precedence, from the flag columns."""
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, column in FLAG_COLUMNS.items():
        label = label.when(F.col(column), name)
    return label.otherwise(UNKNOWN_STACK)


def guess_stack(results: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    return stack_flags(results, projects).select("project_id", stack_label().alias("stack"))


def kind_counts(results: DataFrame) -> DataFrame:
    kind = F.coalesce(F.col("kind"), F.lit("unknown")).alias("kind")
    return results.groupBy("project_id", kind).agg(F.count(F.lit(1)).alias("n"))


def _kind_rows(results: DataFrame, *more: Column) -> DataFrame:
    """One row per project and kind: the only pass over all file rows."""
    kind = F.coalesce(F.col("kind"), F.lit("unknown")).alias("kind")
    return results.groupBy("project_id", kind).agg(
        F.count(F.lit(1)).alias("n"), F.min(_position()).alias("first"), *more
    )


def _dominant_aggregates() -> list[Column]:
    best = F.struct((-F.col("n")).alias("by_n"), F.col("first"))
    return [F.min_by("kind", best).alias("dominant_kind"), F.max("n").alias("dominant_count")]


def dominant_kind(results: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Most frequent kind; of equals the one met first in analysis order."""
    grouped = _kind_rows(results).groupBy("project_id").agg(*_dominant_aggregates())
    return _per_project(grouped, projects).select(
        "project_id",
        F.coalesce("dominant_kind", F.lit("unknown")).alias("dominant_kind"),
        F.coalesce("dominant_count", F.lit(0)).alias("dominant_count"),
    )


def _is_readme() -> Column:
    named = F.lower("rel_path").startswith("readme")
    return named & F.col("kind").startswith("text")


def _readmes(results: DataFrame) -> DataFrame:
    """README rows are few; they are filtered out before they are grouped."""
    return (
        results.filter(_is_readme())
        .groupBy("project_id")
        .agg(F.min_by("summary", _position()).alias("readme"))
    )


def _as_sentence(summary: Column) -> Column:
    return F.concat(F.rtrim(summary, F.lit(".")), F.lit("."))


def readme_line(results: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Summary of the first top-level README, ended by one full stop."""
    listed = results if projects is None else projects
    return _per_project(_readmes(results), listed).select(
        "project_id", _as_sentence(F.col("readme")).alias("readme_line")
    )


def shorten(text: Column, limit: int = SUMMARY_LIMIT) -> Column:
    cut = F.concat(strip_right(F.substring(text, 1, limit - 1)), F.lit(ELLIPSIS))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def project_summary(
    results: DataFrame,
    projects: DataFrame | None = None,
    limit: int = SUMMARY_LIMIT,
    flags: bool = False,
) -> DataFrame:
    """README line, dominant kind, stack and packaging hints as one paragraph.

    Kinds, counts and stack flags come from one pass over the file rows; the
    second grouping and the join work on a few rows per project. ``results``
    is read again for the README rows: pass pinned or written results.
    ``flags`` keeps the stack flags.
    """
    grouped = (
        _kind_rows(results, *_flag_aggregates())
        .groupBy("project_id")
        .agg(*_dominant_aggregates(), *[F.bool_or(c).alias(c) for c in FLAG_COLUMNS.values()])
    )
    filled = (
        _per_project(grouped, projects)
        .join(_readmes(results), "project_id", "left")
        .select(
            "project_id",
            F.coalesce("dominant_kind", F.lit("unknown")).alias("dominant_kind"),
            F.coalesce("dominant_count", F.lit(0)).alias("dominant_count"),
            _as_sentence(F.col("readme")).alias("readme_line"),
            *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in FLAG_COLUMNS.values()],
        )
    )
    paragraph = F.concat_ws(
        " ",
        F.col("readme_line"),
        _filled(KIND_SENTENCE, kind=F.col("dominant_kind"), count=F.col("dominant_count").cast("string")),
        _filled(STACK_SENTENCE, stack=stack_label()),
        F.when(F.col("has_dockerfile"), F.lit(DOCKERFILE_SENTENCE)),
        F.when(F.col("has_packaging"), F.lit(PACKAGING_SENTENCE)),
        F.when(F.col("has_package_json"), F.lit(NODE_SENTENCE)),
    )
    return filled.select(
        "project_id",
        "dominant_kind",
        "dominant_count",
        stack_label().alias("stack"),
        shorten(paragraph, limit).alias("project_summary"),
        *(FLAG_COLUMNS.values() if flags else ()),
    )


def project_components(files: DataFrame) -> DataFrame:
    """Files per top-level directory."""
    top = F.substring_index("rel_path", "/", 1).alias("component")
    return (
        files.filter(F.instr("rel_path", "/") > 0)
        .groupBy("project_id", top)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _ordered_names(n: str, name: str) -> Column:
    """Names by count descending, then by name, from pre-aggregated rows."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("by_n"), F.col(name).alias("name"))))
    return F.transform(pairs, lambda p: p["name"])


def project_stats(
    results: DataFrame, projects: DataFrame | None = None, top_components: int = TOP_COMPONENTS
) -> DataFrame:
    """One row per project: name, counts, languages, frameworks, key components, description and notes.

    The record that :func:`ziplore.operators.validate.check_project_summary`
    accepts. Name lists are built from distinct values with their counts, never
    from file rows. Languages are a fixed set; of the top-level directories, of
    which a project may have any number, the ``top_components`` largest are
    named and ``component_count`` has their number. :func:`project_components`
    is the whole table. Pass pinned or written results.
    """
    totals = results.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("lines").alias("line_count"),
        F.sum("size_bytes").alias("total_bytes"),
    )
    languages = (
        results.filter(F.col("language").isNotNull())
        .groupBy("project_id", "language")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("project_id")
        .agg(_ordered_names("n", "language").alias("languages"))
    )
    listed = project_components(results)
    counted = listed.groupBy("project_id").agg(F.count(F.lit(1)).alias("component_count"))
    largest = top_per_key(
        listed, ["project_id"], [F.desc("n"), F.asc("component")], "component", top_components, "rank"
    )
    components = largest.groupBy("project_id").agg(_ordered_names("n", "component").alias("key_components"))
    frameworks = F.filter(
        F.array(*[F.when(F.col(c), F.lit(name)) for name, c in FLAG_COLUMNS.items()]),
        lambda label: label.isNotNull(),
    )
    none = F.array().cast("array<string>")
    notes = F.concat(F.lit("Top-level components: "), F.array_join("key_components", ", "), F.lit("."))
    return (
        project_summary(results, projects, flags=True)
        .join(totals, "project_id", "left")
        .join(languages, "project_id", "left")
        .join(components, "project_id", "left")
        .join(counted, "project_id", "left")
        .select(
            "project_id",
            project_label(F.col("project_id")).alias("project_name"),
            F.coalesce("file_count", F.lit(0)).alias("file_count"),
            F.coalesce("line_count", F.lit(0)).alias("line_count"),
            F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
            F.coalesce("languages", none).alias("languages"),
            frameworks.alias("frameworks"),
            F.coalesce("component_count", F.lit(0)).alias("component_count"),
            F.coalesce("key_components", none).alias("key_components"),
            F.col("project_summary").alias("description"),
            F.coalesce(shorten(notes, NOTES_CHARS), F.lit("")).alias("architecture_notes"),
        )
    )


def corpus_stats(results: DataFrame) -> DataFrame:
    """Files, lines and bytes over all projects, by kind, extension and language."""
    return results.groupBy("kind", "ext", "language").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("lines").alias("line_count"),
        F.sum("size_bytes").alias("total_bytes"),
        F.count("summary").alias("completed_count"),
    )
