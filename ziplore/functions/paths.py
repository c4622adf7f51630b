"""Path expressions. All take and return columns and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: the extension is the last dot group of a name that has at
# least one character before the dot and one after it.
EXTENSION = r"(?s)\A(.+)([.][^.]+)\z"


def normalise_path(path: Column) -> Column:
    """Backslashes become forward slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def stored_path(member_name: Column) -> Column:
    """Where an archive member lands below the project root.

    Empty, ``.`` and ``..`` segments are dropped, as extraction does.
    """
    kept = F.filter(F.split(member_name, "/"), lambda s: ~s.isin("", ".", ".."))
    return F.array_join(kept, "/")


def escapes_root(member_name: Column) -> Column:
    """True when the member would be written outside the project root.

    The path is absolute, or its running depth drops below zero somewhere.
    """
    steps = F.transform(
        F.split(member_name, "/"),
        lambda s: F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1),
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest"))
    walked = F.aggregate(
        steps,
        start,
        lambda acc, step: F.struct(
            (acc.depth + step).alias("depth"),
            F.least(acc.lowest, acc.depth + step).alias("lowest"),
        ),
    )
    return member_name.startswith("/") | (walked.lowest < 0)


def base_name(path: Column) -> Column:
    """Last segment of a path that is already normalised."""
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """Everything before the last segment; empty for a top-level path."""
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(
        F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)
    )


def depth_of(path: Column) -> Column:
    """Number of segments of a path that is already normalised."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + F.lit(1)


def extension_of(name: Column) -> Column:
    """Lower-cased extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(name, EXTENSION, 2))


def stem_of(name: Column) -> Column:
    """Lower-cased name without its extension."""
    stem = F.regexp_extract(name, EXTENSION, 1)
    return F.lower(F.when(stem == "", name).otherwise(stem))


def path_parts(path: Column) -> dict[str, Column]:
    """name, stem, ext, parent, depth and parts of any relative path.

    Repeated slashes and ``.`` segments do not count, as in path libraries.
    """
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    clean = F.array_join(parts, "/")
    name = base_name(clean)
    return {
        "name": name,
        "stem": stem_of(name),
        "ext": extension_of(name),
        "parent": parent_of(clean),
        "depth": F.size(parts),
        "parts": parts,
    }


def upload_name_accepted(name: Column) -> Column:
    """Uploads must be named ``*.zip`` in any case."""
    return F.coalesce(F.lower(name).endswith(".zip"), F.lit(False))
