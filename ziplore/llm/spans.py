"""Spans of regular expressions in whole texts, with built-in functions only.

A span is ``struct<start, end, hit>`` in code points, end exclusive. Spark has
no function for the places of matches, so they are summed up from the matches
and the gaps between them, which one expression gives for one pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,end:bigint,hit:string>"


def spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of a pattern that never matches empty."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),
        lambda x: F.struct(
            F.char_length(x["gap"]).cast("long").alias("gap"),
            F.coalesce(F.char_length(x["hit"]), F.lit(0)).cast("long").alias("size"),
            x["hit"].alias("hit"),
        ),
    )
    # Bound to a name, so that the text is searched once.
    return _bound(parts, _placed)


#: Parts that are walked together. The walk copies what it has found at every
#: step, so texts of very many matches are walked in slices.
WALKED = 256


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(parts: Column) -> Column:
    """Spans of parts ``struct<gap, size, hit>`` that follow each other."""
    slices = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / F.lit(WALKED)).cast("int")),
        lambda n: F.slice(parts, n * F.lit(WALKED) + 1, F.lit(WALKED)),
    )
    return _bound(slices, lambda cut: F.flatten(F.zip_with(cut, _starts(cut), _walked)))


def _starts(slices: Column) -> Column:
    """Where each slice of parts begins."""
    zero = F.lit(0).cast("long")
    widths = F.transform(slices, lambda q: F.aggregate(q, zero, lambda at, x: at + x["gap"] + x["size"]))
    return F.aggregate(
        widths,
        F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        lambda acc: acc["starts"],
    )


def _walked(parts: Column, start: Column) -> Column:
    none = F.array().cast(f"array<{SPAN}>")
    return F.aggregate(
        parts,
        F.struct(start.alias("at"), none.alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(x["hit"].isNull(), acc["found"])
            .otherwise(
                F.concat(
                    acc["found"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"),
                            (acc["at"] + x["gap"] + x["size"]).alias("end"),
                            x["hit"].alias("hit"),
                        )
                    ),
                )
            )
            .alias("found"),
        ),
        lambda acc: acc["found"],
    )


def spans_where(gate: Column, text: Column, pattern: str) -> Column:
    """``spans`` for the texts that pass a cheap test, none for others."""
    return F.when(gate, spans(text, pattern)).otherwise(F.array().cast(f"array<{SPAN}>"))


def spans_with_context(gate: Column, text: Column, pattern: str, width: int = 40) -> Column:
    """``spans`` with the text ``before`` and ``after`` each, up to the next match or ``width``."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    near = F.transform(
        gaps,
        lambda g: F.struct(
            F.right(g, F.lit(width)).alias("tail"), F.left(g, F.lit(width)).alias("head")
        ),
    )
    empty = F.array().cast(
        "array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>"
    )
    zipped = F.zip_with(
        F.zip_with(spans(text, pattern), near, lambda s, g: F.struct(s.alias("s"), g["tail"].alias("b"))),
        F.slice(near, 2, F.greatest(F.size(hits), F.lit(1))),
        lambda x, g: F.struct(
            x["s"]["start"].alias("start"),
            x["s"]["end"].alias("end"),
            x["s"]["hit"].alias("hit"),
            x["b"].alias("before"),
            g["head"].alias("after"),
        ),
    )
    # The gaps are one more than the matches: the last place of the first zip holds no span.
    return F.when(gate, F.filter(zipped, lambda x: x["hit"].isNotNull())).otherwise(empty)


def ranked(found: Column, rank: int, kind: str) -> Column:
    """Spans as ``struct<start, rank, end, kind>``, which sorts by start, then kind as listed."""
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
        ),
    )


def listing(found: Column) -> Column:
    """``kind:start:end`` of ranked spans in order, joined by commas."""
    return F.array_join(
        F.transform(
            F.sort_array(found),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
