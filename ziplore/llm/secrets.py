"""Secrets: strong patterns, and weak parts that count only where parts of one credential meet.

Three base kinds are fixed patterns and always stay. Weak parts (unprefixed
access ids, bare key material, endpoints) are everywhere in sound texts, so
they are reported only when complementary parts stand near them in the same
scope, a block between blank lines: key material beside an access id or an
endpoint, an access id beside key material, an endpoint beside both. A part
inside an endpoint, as in an URL with a password, is at distance 0. Key material
that is an access id as well is one token, so it is no company to itself.

Parts are found in one pass without a shuffle. Only the weak parts' documents
go on, as narrow rows: their parts are pre-aggregated per scope and bin of
text, and an equi-join on neighbouring bins answers "is there a part within
reach", so a crowded scope yields a few rows per weak part, never pairs.

Defined results: a null text counts as empty; repeated rows are searched each;
an empty table gives an empty result. Columns of the input that clash with
those added are replaced, those that begin with an underscore are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ziplore.llm.spans import ranked, spans_where
from ziplore.session import pin

ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGNED = 8
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
BASE = ("assign", "access", "hex")

#: Weak parts: kind, role, what a text must hold to be searched, pattern.
WEAK = (
    ("key_id", "access", r"[A-Z0-9]{16}", r"(?<![A-Za-z0-9])(?=[A-Z]{0,40}[0-9])(?=[0-9]{0,40}[A-Z])[A-Z0-9]{16,40}(?![A-Za-z0-9])"),
    ("key_material", "secret", r"[A-Za-z0-9+/]{32}", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/]*+[0-9])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=_-])"),
    ("endpoint", "endpoint", r"://|(?i)(?:host|endpoint|server)\s*[:=]", r"(?i)(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mongodb)://[^\x20\x09-\x0D\"'<>]+|(?:host|endpoint|server)\x20*[:=]\x20*[\"']?[a-z0-9.-]+(?::[0-9]+)?"),
)
ROLE = {"assign": "secret", "access": "access", "hex": "secret"} | {k: r for k, r, _, _ in WEAK}
BREAK = r"\n[\x20\x09\x0D]*\n"

#: Greatest distance between complementary parts, in code points.
REACH = 300


def base_spans(text: Column) -> dict[str, Column]:
    assigned = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return {
        "assign": F.filter(
            spans_where(assigned, text, ASSIGN),
            lambda s: F.char_length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= ASSIGNED,
        ),
        "access": spans_where(F.contains(text, F.lit("AKIA")), text, ACCESS),
        "hex": spans_where(text.rlike("[0-9a-f]{32}"), text, HEX),
    }


def _covered(span: Column, taken: Column) -> Column:
    return F.exists(taken, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))


def find_parts(docs: DataFrame) -> DataFrame:
    """Replace the text by ``base`` and ``weak`` spans and the places of blank lines, ``breaks``."""
    kept = [c for c in docs.columns if c not in ("text", "base", "weak", "breaks", "found") and not c.startswith("_")]
    text = F.col("_text")
    base = base_spans(text)
    first = docs.select(*kept, F.coalesce("text", F.lit("")).alias("_text")).select(
        *kept, "_text", F.concat(*[ranked(base[k], i, k) for i, k in enumerate(BASE)]).alias("base")
    )
    weak = F.concat(
        *[
            ranked(
                F.filter(spans_where(text.rlike(gate), text, pattern), lambda s: ~_covered(s, F.col("base"))),
                len(BASE) + i,
                kind,
            )
            for i, (kind, _, gate, pattern) in enumerate(WEAK)
        ]
    )
    second = first.select(*kept, "_text", "base", weak.alias("weak"))
    # A weak part needs company, so a text with a single part needs no scopes.
    breaks = spans_where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1), text, BREAK)
    return second.select(*kept, "base", "weak", F.transform(breaks, lambda s: s["start"]).alias("breaks"))


def _role(kind: str) -> Column:
    return F.coalesce(*[F.when(F.col(kind) == k, r) for k, r in ROLE.items()])


def _scoped(parts: DataFrame) -> DataFrame:
    """One row per part of texts with weak parts and company, with its scope's number."""
    busy = parts.filter((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1))
    rows = busy.select(
        "_row",
        F.explode(
            F.concat(
                F.transform("base", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind")], F.lit(False).alias("weak"))),
                F.transform("weak", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind")], F.lit(True).alias("weak"))),
                F.transform("breaks", lambda b: F.struct(b.alias("start"), F.lit(-1).alias("rank"), b.alias("end"), F.lit("").alias("kind"), F.lit(False).alias("weak"))),
            )
        ).alias("s"),
    ).select("_row", "s.*")
    so_far = Window.partitionBy("_row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_scope", F.sum((F.col("rank") == -1).cast("int")).over(so_far))
        .filter(F.col("rank") >= 0)
        .withColumn("_role", _role("kind"))
    )


def link_parts(parts: DataFrame) -> DataFrame:
    """Weak parts with complementary parts within ``REACH`` in their scope.

    A part within reach on the right starts in the bin of the weak part's end
    or the next; one on the left ends in the bin of its start or the one
    before. Per scope, role and bin the least and greatest place suffice. Parts
    and endpoints that share a bin are within reach or overlap, so for those
    that overlap each part is entered in every bin it covers.
    """
    rows = pin(_scoped(parts))
    key = ["_row", "_scope"]
    bins = F.sequence(F.floor(F.col("start") / REACH), F.floor((F.col("end") - 1) / REACH))
    near = (
        rows.select(*key, "_role", F.explode(F.array(
            F.struct(F.lit("right").alias("side"), F.col("start").alias("at")),
            F.struct(F.lit("left").alias("side"), F.col("end").alias("at")),
        )).alias("p"))
        .groupBy(*key, F.col("_role").alias("_other"), F.col("p.side").alias("_side"), F.floor(F.col("p.at") / REACH).alias("_bin"))
        .agg(F.min("p.at").alias("_low"), F.max("p.at").alias("_high"))
    )
    none = F.lit(None).cast("long")
    over = rows.select(*key, F.col("_role").alias("_other"), F.lit("over").alias("_side"), F.explode(bins).alias("_bin")).distinct()
    near = near.unionByName(over.withColumns({"_low": none, "_high": none}))
    right, left = F.floor(F.col("end") / REACH), F.floor(F.col("start") / REACH)
    asked = rows.filter("weak").select(
        *key, "start", "rank", "end", "kind", "_role",
        F.explode(F.concat(F.transform(bins, lambda b: F.struct(F.lit("over").alias("side"), b.alias("bin"))), F.array(
            *[F.struct(F.lit("right").alias("side"), (right + i).alias("bin")) for i in (0, 1)],
            *[F.struct(F.lit("left").alias("side"), (left - i).alias("bin")) for i in (0, 1)],
        ))).alias("q"),
    ).select(*key, "start", "rank", "end", "kind", "_role", F.col("q.side").alias("_side"), F.col("q.bin").alias("_bin"))
    within = F.when(
        F.col("_side") == "over", (F.col("_role") == "endpoint") | (F.col("_other") == "endpoint")
    ).when(
        F.col("_side") == "right",
        ((F.col("_high") >= F.col("end")) & (F.col("_low") <= F.col("end") + REACH)),
    ).otherwise((F.col("_low") <= F.col("start")) & (F.col("_high") >= F.col("start") - REACH))
    met = (
        asked.join(near, [*key, "_side", "_bin"])
        .filter((F.col("_other") != F.col("_role")) & within)
        .groupBy("_row", "start", "rank", "end", "kind", "_role")
        .agg(
            F.max((F.col("_other") == "access").cast("int")).alias("_access"),
            F.max((F.col("_other") == "secret").cast("int")).alias("_secret"),
            F.max((F.col("_other") == "endpoint").cast("int")).alias("_endpoint"),
        )
    )
    complete = (
        F.when(F.col("_role") == "secret", F.col("_access") + F.col("_endpoint") >= 1)
        .when(F.col("_role") == "access", F.col("_secret") == 1)
        .otherwise(F.col("_access") + F.col("_secret") == 2)
    )
    return met.filter(complete).select("_row", "start", "rank", "end", "kind")


def find_secrets(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but the text, with ``base`` and all reported spans, ``found``.

    Both are arrays of ``struct<start, rank, end, kind>``.
    """
    parts = pin(find_parts(docs).withColumn("_row", F.monotonically_increasing_id()))
    linked = (
        link_parts(parts)
        .groupBy("_row")
        .agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("_linked"))
    )
    return parts.join(linked, "_row", "left").select(
        *[c for c in parts.columns if c not in ("weak", "breaks", "found", "_row")],
        F.when(F.col("_linked").isNull(), F.col("base")).otherwise(F.concat("base", "_linked")).alias("found"),
    )
