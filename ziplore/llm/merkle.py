"""Merkle manifest of a dataset: hash trees with proofs, by nested intervals of leaf ranks.

Leaves of a group (a source) are ranked; every node is known by the interval
``[lo, hi)`` of the leaf ranks below it. ``ARITY`` consecutive nodes become one of
the next level, so a node of level ``l`` lies in the bucket ``lo / ARITY ** (l + 1)``
of its parent's level. The groups' roots are the leaves of one more tree, whose
root stands for the dataset.

Proofs go downwards. At each level a containment join, by group and bucket,
attaches the parent, which brings its children and what was attached to itself.
The parent's interval less the node's own leaves two intervals: the children in
them are the siblings to its left and to its right. So long strings are kept
once for each parent, not for each document, and no task sees more than
``ARITY`` rows of a key, however many documents a group holds.

Groups are ranked by a range sort whose copy is pinned, as are the levels; only
the greatest number of leaves reaches the driver.

Defined results: nulls in any hashed column are told from empty strings; rows
without a group form a group of their own, before the others; rows without an
id stand before the others of their group; rows of one id go by their digest,
and equal rows are leaves of their own; texts of any length are one digest; an
empty table has no leaves and no root. Only the named columns are read, so
others may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ziplore.operators.ranking import rank_by_sort
from ziplore.session import pin

ARITY = 16


def digest(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of some values: each ``-`` if null, else its length in bytes, a colon and itself."""
    written = [c.cast("string") for c in columns]
    parts = [F.concat(F.octet_length(c).cast("string"), F.lit(":"), c) for c in written]
    return digest(F.concat(*[F.coalesce(p, F.lit("-")) for p in parts]))


@dataclass
class Manifest:
    """Levels of the groups' trees and of the tree over their roots, leaves first.

    A node is ``tree``, ``lo``, ``hi``, ``n`` (leaves of its tree), ``digest`` and,
    above the leaves, its ``children``. Leaves carry the columns asked for.
    """

    levels: list[DataFrame]
    top: list[DataFrame]
    carried: list[str]


def _span(level: int) -> int:
    return ARITY**level


def _bucket(level: int) -> Column:
    return F.expr(f"lo div {_span(level)}")


def _is_root() -> Column:
    return (F.col("lo") == 0) & (F.col("hi") == F.col("n"))


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels above pinned leaves."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0]
    while most is not None and most > _span(len(levels) - 1):
        level = len(levels)
        children = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
        grouped = (
            levels[-1]
            .filter(~_is_root())
            .groupBy("tree", _bucket(level).alias("_bucket"))
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"), children.alias("children"))
            .drop("_bucket")
        )
        joined = F.array_join(F.transform("children", lambda c: c["digest"]), "")
        levels.append(pin(grouped.withColumn("digest", digest(joined))))
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    roots = None
    for level in levels:
        found = level.filter(_is_root()).select("tree", "digest")
        roots = found if roots is None else roots.unionByName(found)
    return roots


def _ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    ranked = rank_by_sort(leaves, ["tree"], order, "hi", total="n")
    return pin(ranked.withColumn("lo", F.col("hi") - 1))


def build_manifest(docs: DataFrame, leaf: str, group: str, order: str, carry: list[str]) -> Manifest:
    """Trees over the digests in column ``leaf``, one for each ``group``, leaves in ascending ``order``."""
    # A tree's name sorts as the group does, null first, and is never null.
    tree = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = pin(docs.select(tree.alias("tree"), F.col(order).alias("_order"), F.col(leaf).alias("digest"), *carry))
    levels = _levels(_ranked(leaves, ["_order", "digest", *carry]).drop("_order"))
    roots = _roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    return Manifest(levels, _levels(_ranked(roots, ["group"])), carry)


def _attached(levels: list[DataFrame], above: DataFrame, more: list[str]) -> DataFrame:
    """Every leaf with its path to its tree's root, followed by what ``above`` has for that root.

    ``above`` is ``tree``, ``path`` and ``more``, one row for each tree.
    """
    parents = None
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level]
        found = nodes.filter(_is_root()).join(above, "tree")
        if parents is not None:
            rest = nodes.filter(~_is_root()).withColumn("_bucket", _bucket(level + 1)).alias("c")
            p = parents.select(
                "tree", _bucket(level + 1).alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                F.col("children").alias("_children"), F.col("path").alias("_path"), *more,
            )
            inside = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            joined = rest.join(p, ["tree", "_bucket"]).filter(inside)
            before = F.filter("_children", lambda s: s["hi"] <= F.col("lo"))
            after = F.filter("_children", lambda s: s["lo"] >= F.col("hi"))
            text = [F.array_join(F.transform(side, lambda s: s["digest"]), "") for side in (before, after)]
            step = F.struct(text[0].alias("left"), text[1].alias("right"))
            rest = joined.withColumn("path", F.concat(F.array(step), "_path"))
            found = found.unionByName(rest.select(*found.columns))
        parents = found
    return parents


PATH = "array<struct<left:string,right:string>>"


def prove(manifest: Manifest) -> DataFrame:
    """Every leaf with ``leaf``, ``subroot``, ``root`` and its ``path``, besides the carried columns.

    ``path`` has a step for each level up to the root of all: the digests of the
    siblings to the left and to the right, each side joined.
    """
    whole = _roots(manifest.top).select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    roots = _attached(manifest.top, whole, ["root"]).select(
        F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"), "root"
    )
    leaves = _attached(manifest.levels, pin(roots), ["subroot", "root"])
    return leaves.select(*manifest.carried, F.col("digest").alias("leaf"), "subroot", "root", "path")


def siblings(path: str = "path") -> Column:
    """Digests of all siblings, from the leaf's level upwards, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf gives with its siblings."""
    return F.aggregate(path, leaf, lambda held, s: digest(F.concat(s["left"], held, s["right"])))
