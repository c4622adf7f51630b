"""Directory trees without recursion.

A node is one distinct path prefix. Its place among its siblings is that of the
first file below it in (depth, name, seq) order. Lines are numbered by sizes of
subtrees: a node's line is its parent's plus one plus the sizes of its earlier
siblings. So nodes are only ever ordered among their siblings; no sort goes over
a project. Whether a node is the last child of its parent decides the guide
drawn under it. Line and guides of a directory are sums along its path, and a
node meets them in one join with its parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ziplore.functions.paths import base_name, depth_of, parent_of
from ziplore.operators.joins import count_keys, join_measured
from ziplore.operators.ranking import rank_by_slices
from ziplore.session import pin

STYLES = ("guides", "flat", "grouped")
LINES_PER_PART = 10_000

# What is drawn for a node and below it.
BRANCH, LAST_BRANCH = "├── ", "└── "
PIPE, GAP = "│   ", "    "


def _place(depth: Column, path: Column, seq: Column) -> Column:
    return F.struct(
        depth.alias("depth"), base_name(path).alias("name"), seq.alias("seq")
    )


def tree_nodes(files: DataFrame) -> DataFrame:
    """One row per path prefix: name, parent, depth, ``is_dir`` and first place.

    Files are reduced to their directories before prefixes are exploded, so the
    explosion grows with directories, not with files.
    """
    path = F.col("rel_path")
    placed = files.select(
        "project_id",
        path.alias("node"),
        _place(depth_of(path), path, F.col("seq")).alias("first"),
    )
    leaves = placed.select("project_id", "node", F.lit(False).alias("as_dir"), "first")
    directories = (
        placed.withColumn("dir", parent_of(F.col("node")))
        .filter(F.col("dir") != "")
        .groupBy("project_id", "dir")
        .agg(F.min("first").alias("first"))
        .withColumn("parts", F.split("dir", "/"))
        .withColumn("level", F.explode(F.sequence(F.lit(1), F.size("parts"))))
        .select(
            "project_id",
            F.array_join(F.slice("parts", 1, F.col("level")), "/").alias("node"),
            F.lit(True).alias("as_dir"),
            "first",
        )
    )
    nodes = (
        leaves.unionByName(directories)
        .groupBy("project_id", "node")
        .agg(
            F.min("first").alias("first"),
            F.bool_and("as_dir").alias("is_dir"),
            F.bool_or("as_dir").alias("has_children"),
        )
    )
    node = F.col("node")
    return nodes.select(
        "project_id",
        "node",
        parent_of(node).alias("parent"),
        base_name(node).alias("name"),
        depth_of(node).alias("depth"),
        "is_dir",
        "has_children",
        "first",
    )


def _last_children(nodes: DataFrame) -> DataFrame:
    """The last child of every directory; both sides of a join on it are unique, so a huge directory is no hot key."""
    last = nodes.groupBy("project_id", "parent").agg(F.max_by("node", "first").alias("node"))
    return last.select("project_id", "node", F.lit(True).alias("is_last"))


def tree_order(files: DataFrame) -> DataFrame:
    """Nodes with ``sibling_rank`` (from 1) and ``is_last``."""
    nodes = pin(tree_nodes(files))
    ranked = rank_by_slices(nodes, ["project_id", "parent"], ["first"], out="sibling_rank")
    flagged = ranked.join(_last_children(nodes), ["project_id", "node"], "left")
    return flagged.withColumn("is_last", F.coalesce("is_last", F.lit(False))).drop("first", "has_children")


def file_order(files: DataFrame) -> DataFrame:
    """Add ``ord``: files of a project by depth, then name, then discovery."""
    place = _place(depth_of(F.col("rel_path")), F.col("rel_path"), F.col("seq"))
    return rank_by_slices(pin(files), ["project_id"], [place], out="ord")


def _numbered_nodes(nodes: DataFrame) -> DataFrame:
    """Pinned nodes with ``size`` of their subtree, ``is_last`` and ``step``: how many lines a node comes after its parent."""
    children = count_keys(nodes, ["project_id", "parent"])
    # A directory holds as many nodes as all directories at or below it have children.
    below = _on_path(children).groupBy("project_id", F.col("ancestor").alias("node")).agg(F.sum("_n").alias("_below"))
    sized = (
        nodes.join(below, ["project_id", "node"], "left")
        .join(_last_children(nodes), ["project_id", "node"], "left")
        .withColumn("size", F.coalesce("_below", F.lit(0)) + 1)
        .withColumn("is_last", F.coalesce("is_last", F.lit(False)))
        .drop("_below")
    )
    ranked = rank_by_slices(sized, ["project_id", "parent"], ["first"], "_rank", value="size", counts=children)
    return pin(ranked.withColumn("step", F.col("size_before") + 1).drop("_rank", "size_before", "first"))


def _on_path(children: DataFrame) -> DataFrame:
    """Each directory below the root with every directory on its path, itself included."""
    parts = F.split("parent", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return children.filter(F.col("parent") != "").select(
        "project_id", F.col("parent").alias("dir"), "_n", F.posexplode(levels).alias("level", "ancestor")
    )


def _guide_lines(files: DataFrame) -> DataFrame:
    """Every node with its drawn line and the line's number."""
    nodes = _numbered_nodes(pin(tree_nodes(files)))
    children = count_keys(nodes, ["project_id", "parent"])
    steps = _on_path(children)
    own = nodes.filter("has_children").select("project_id", F.col("node").alias("ancestor"), "step", "is_last")
    drawn = F.transform(
        F.array_sort(F.collect_list(F.struct("level", "is_last"))), lambda c: F.when(c["is_last"], GAP).otherwise(PIPE)
    )
    directories = (
        join_measured(steps.drop("_n"), own, ["project_id", "ancestor"], "dir", counts=count_keys(steps, ["project_id", "ancestor"]))
        .groupBy("project_id", F.col("dir").alias("parent"))
        .agg(F.sum("step").alias("_line"), F.array_join(drawn, "").alias("_guides"))
    )
    rows = join_measured(nodes, directories, ["project_id", "parent"], "node", "left", counts=children)
    line = F.concat(
        F.coalesce("_guides", F.lit("")),
        F.when(F.col("is_last"), F.lit(LAST_BRANCH)).otherwise(F.lit(BRANCH)),
        F.col("name"),
        F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")),
    )
    number = F.coalesce("_line", F.lit(0)) + F.col("step")
    return rows.select("project_id", number.alias("line_no"), "node", "parent", "depth", "is_dir", line.alias("line"))


def _flat_rows(files: DataFrame) -> DataFrame:
    """File lines only, by depth then name."""
    path = F.col("rel_path")
    return files.select(
        "project_id",
        path.alias("node"),
        parent_of(path).alias("parent"),
        depth_of(path).alias("depth"),
        F.lit(False).alias("is_dir"),
        _indented(path).alias("line"),
        _place(depth_of(path), path, F.col("seq")).alias("sort_key"),
    )


def _grouped_rows(files: DataFrame) -> DataFrame:
    """File lines only, by path segments, directories kept together.

    Directories follow each other in the order of their first file.
    """
    path = F.col("rel_path")
    rows = pin(
        files.select(
            "project_id",
            path.alias("node"),
            parent_of(path).alias("parent"),
            depth_of(path).alias("depth"),
            F.lit(False).alias("is_dir"),
            _indented(path).alias("line"),
            F.split(path, "/").alias("parts"),
            "seq",
        )
    )
    starts = rows.groupBy("project_id", "parent").agg(F.min("parts").alias("start"))
    return join_measured(rows, starts, ["project_id", "parent"], "node").select(
        "project_id",
        "node",
        "parent",
        "depth",
        "is_dir",
        "line",
        F.struct("start", "parts", "seq").alias("sort_key"),
    )


def _indented(path: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), depth_of(path) - 1), base_name(path))


def _sorted_lines(rows: DataFrame) -> DataFrame:
    return rank_by_slices(pin(rows), ["project_id"], ["sort_key"], out="line_no")


_LINES = {
    "guides": _guide_lines,
    "flat": lambda files: _sorted_lines(_flat_rows(files)),
    "grouped": lambda files: _sorted_lines(_grouped_rows(files)),
}


def tree_lines(files: DataFrame, style: str = "guides", projects: DataFrame | None = None) -> DataFrame:
    """Rendered lines per project, numbered from 0 (the root line).

    Files must be unique per path. ``projects`` adds the root line of projects
    without files.
    """
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}, not {style!r}")
    body = _LINES[style](files)
    columns = ["project_id", "line_no", "node", "parent", "depth", "is_dir", "line"]
    roots = (files if projects is None else projects).select("project_id").distinct()
    root_lines = roots.select(
        "project_id",
        F.lit(0).cast("long").alias("line_no"),
        F.lit("").alias("node"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(0).alias("depth"),
        F.lit(True).alias("is_dir"),
        F.concat("project_id", F.lit("/")).alias("line"),
    )
    return root_lines.unionByName(body.select(*columns))


def tree_text(lines: DataFrame, lines_per_part: int = LINES_PER_PART) -> DataFrame:
    """Tree text per project in parts of at most ``lines_per_part`` lines.

    An ordinary project is one part (number 0). A larger one goes on in further
    parts, so no task ever holds more than one part.
    """
    part = F.floor(F.col("line_no") / lines_per_part).alias("part")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("project_id", part).agg(
        F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("tree_text"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def attach_file_info(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Tree nodes with the analysis result of the file they stand for.

    Directories and files that were not analysed have nulls.
    """
    info = results.select(
        "project_id", F.col("rel_path").alias("node"), "kind", "summary", "lines", "size_bytes", "language"
    )
    return nodes.join(info, ["project_id", "node"], "left")
