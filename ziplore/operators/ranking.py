"""Ranks and top-n per key that hold when one key has a third of all rows.

A plain ``row_number`` over a key sorts that key's rows in one task. These
forms cut each key into bounded slices first and stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ziplore.operators.joins import count_keys, hot_keys
from ziplore.session import pin

# A key is cut for ranking when it has more than one CUT_SHARE-th of all rows,
# and at least CUT_ROWS of them. Borders come from so many rows for each slice.
CUT_SHARE = 1024
CUT_ROWS = 65_536
SAMPLED = 32
SPREAD = 64


def rank_by_slices(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    out: str,
    value: str | None = None,
    counts: DataFrame | None = None,
    share: int = CUT_SHARE,
    least: int = CUT_ROWS,
) -> DataFrame:
    """Row number per key in any total order; with ``value``, also ``<value>_before``: its sum over earlier rows of the key.

    Keys that hold a large share of all rows are cut into slices of about equal
    rows in that order: the borders are quantiles of rows picked by their hash,
    so they follow the data, sparse or dense, numbers or strings. Rows are exact
    whatever the borders: each slice is ranked on its own and shifted by what the
    slices before it hold. Fewer than ``share`` keys are cut, into fewer than
    twice as many slices, so the borders are broadcast. Other keys are ranked
    whole. Nothing is sorted over the whole corpus.

    Keys must not be null. ``counts`` are the rows ``_n`` of each key, when they
    are known. The frame is read once more for each key count, border and offset
    that is needed: pass a pinned one.
    """
    names = [f"_o{i}" for i in range(len(order))]
    cols = [(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(order, names)]
    tagged = df.select("*", F.struct(*cols).alias("_order"))
    hot = hot_keys(count_keys(df, keys) if counts is None else counts, keys, share, least)
    before = f"{value}_before"
    added = [out, before] if value else [out]
    if hot.isEmpty():
        whole = Window.partitionBy(*keys).orderBy("_order")
        ranked = tagged.withColumn(out, F.row_number().over(whole).cast("long"))
        if value:
            earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
            ranked = ranked.withColumn(before, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
        return ranked.select(*df.columns, *added)
    picked = tagged.join(F.broadcast(hot), keys).filter(F.pmod(F.xxhash64("_order"), F.col("_n")) < F.col("_slices") * SAMPLED)
    borders = (
        picked.groupBy(*keys, "_slices")
        .agg(F.sort_array(F.collect_set("_order")).alias("_seen"))
        .select(
            *keys,
            F.expr("transform(sequence(1, _slices), i -> _seen[cast(floor((i - 1) * size(_seen) / _slices) as int)])").alias("_borders"),
        )
    )
    number = F.size(F.filter("_borders", lambda b: b <= F.col("_order")))
    cut = tagged.join(F.broadcast(borders), keys, "left").withColumn("_slice", F.coalesce(number, F.lit(0))).drop("_borders")
    past = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.count(F.lit(1)).alias("_rows"), *([F.sum(value).alias("_sum")] if value else [])]
    offsets = cut.groupBy(*keys, "_slice").agg(*totals).withColumn("_rows", F.coalesce(F.sum("_rows").over(past), F.lit(0)))
    if value:
        offsets = offsets.withColumn("_sum", F.coalesce(F.sum("_sum").over(past), F.lit(0)))
    within = Window.partitionBy(*keys, "_slice").orderBy("_order")
    ranked = cut.join(offsets, [*keys, "_slice"]).withColumn(out, (F.col("_rows") + F.row_number().over(within)).cast("long"))
    if value:
        earlier = within.rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.withColumn(before, F.col("_sum") + F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    return ranked.select(*df.columns, *added)


def rank_by_sort(
    df: DataFrame, keys: list[str], order: list[Column | str], out: str, total: str | None = None
) -> DataFrame:
    """Row number per key in any total order; ``total`` names a column for the number of the key's rows.

    Keys must not be null.

    The rows are range-sorted on key and order, so a large key spreads over
    many partitions, and pinned, because their place in a partition becomes
    data. A key's run in each partition is then shifted by the length of its
    runs in earlier partitions: at most one row per key and partition.
    """
    position = F.monotonically_increasing_id()
    placed = pin(df.orderBy(*keys, *order).withColumn("_pos", position)).withColumn(
        "_slice", F.shiftrightunsigned("_pos", 33)
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        placed.groupBy(*keys, "_slice")
        .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )
    if total:
        runs = runs.withColumn(total, F.sum("_rows").over(Window.partitionBy(*keys)))
    return (
        placed.join(runs.drop("_rows"), [*keys, "_slice"])
        .withColumn(out, F.col("_offset") + F.col("_pos") - F.col("_first") + F.lit(1))
        .select(*df.columns, out, *([total] if total else []))
    )


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], seq: str, n: int, out: str
) -> DataFrame:
    """First ``n`` rows per key with their row number.

    Each key is cut into hash slices that are limited on their own, so the
    final sort sees at most ``n`` rows per slice. Spark also limits each task's
    share before the shuffle.
    """
    part = F.pmod(F.xxhash64(seq), F.lit(SPREAD))
    first = Window.partitionBy(*keys, "_part").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_part", part)
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= n)
        .drop("_n", "_part")
        .withColumn(out, F.row_number().over(final).cast("long"))
        .filter(F.col(out) <= n)
    )
