"""Joins of per-key facts to rows of which one key may hold a large share.

Spark's own skew handling splits a join only where both sides come straight
from a shuffle. Facts come from a grouping on the same key, so these joins cut
large keys themselves; they stay exact and plain equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot with more than one HOT-th of all rows, and at least so many.
HOT = 256
LEAST_HOT = 1000


def hot_keys(counts: DataFrame, keys: list[str], hot: int = HOT, least: int = LEAST_HOT) -> DataFrame:
    """Keys with more than one ``hot``-th of all rows, their rows ``_n`` and into how many ``_slices`` to cut them.

    ``counts`` has a row per key with its rows ``_n``. There are fewer than ``hot``
    such keys and fewer than twice as many slices, so the result may be
    broadcast whatever the input.
    """
    total = counts.agg(F.sum("_n")).scalar()
    slices = F.ceil(F.col("_n") * hot / total).cast("int")
    return counts.filter(F.col("_n") * hot > total).filter(F.col("_n") > least).select(*keys, "_n", slices.alias("_slices"))


def count_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def join_measured(
    rows: DataFrame, facts: DataFrame, keys: list[str], spread_by: str, how: str = "inner", counts: DataFrame | None = None
) -> DataFrame:
    """Join per-key facts to rows, cutting each key into as many slices as its share of the rows asks for.

    Rows of a key are spread over its slices by a hash and its facts are repeated
    for each. Only keys with more than one ``HOT``-th of all rows are cut, so they are
    broadcast, and facts of other keys are not repeated. ``counts`` are the rows
    ``_n`` of each key; without them ``rows`` are read twice more: pass pinned ones.
    """
    hot = hot_keys(count_keys(rows, keys) if counts is None else counts, keys).drop("_n")
    cut = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), F.coalesce("_slices", F.lit(1))).cast("int")
    )
    repeated = facts.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
    )
    return cut.drop("_slices").join(repeated.drop("_slices"), [*keys, "_salt"], how).drop("_salt")


#: Keys that are broadcast for an anti-join, at most (some 100 bytes each).
BROADCAST_KEYS = 100_000


def anti_join(rows: DataFrame, keys_out: DataFrame, keys: list[str], spread_by: str) -> DataFrame:
    """Rows whose key is not in ``keys_out``; pass pinned frames.

    Few keys are counted and broadcast, so rows don't move; with more of them
    keys of a large share of the rows are cut.
    """
    out = keys_out.select(*keys).distinct()
    if out.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(out), keys, "left_anti")
    return join_measured(rows, out, keys, spread_by, "left_anti")
