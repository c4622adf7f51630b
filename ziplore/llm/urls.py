"""URL filters: rules by host and path, and an exact block list as a cascade of Bloom filters.

Rules are few and become one expression. For URLs that no rule fits, a listed
host or a listed parent domain blocks. The list is held as a cascade: the first
filter encodes the listed keys, the second those keys of the corpus that pass
the first without being listed, the third the listed keys that pass the second,
and so on until no key of the corpus is answered wrongly. As every key that can
be asked is a key of the corpus, membership is exact, and it is looked up in
bit arrays inside the row's own task instead of by a join.

Filters are built with groupings (the bits of each 32-bit word are or-ed
together before anything moves) and reach the tasks as one row of arrays. That
row is broadcast only up to ``MAX_CASCADE_WORDS``; a longer list is answered by
an equi-join on the key.

Defined results: host and path of a null URL, or one without ``://``, are
empty; such a URL is allowed; repeated rows are judged each; an empty table
gives an empty result, and an empty list allows. Columns of the input that
clash with those added are replaced, those that begin with an underscore dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ziplore.session import pin

#: The rules as given: host, path, verdict. Fixed values.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Words of host labels that put a host on the block list.
LISTED_WORDS = ("casino", "bets", "pills", "adult", "spam", "ads")

#: Parent domains that are tested in the row's own expression, one test each.
#: Hosts of more labels are rare; their parents are tested as rows.
UNROLLED = 8

#: Filter bits per encoded key, hash functions, and greatest number of levels
#: before the remaining keys are stated outright.
BITS_PER_KEY = 10
HASHES = 5
MAX_LEVELS = 24
#: Words of 32 bits in all levels together that are sent to every task (16 MB
#: as longs): some 6 million encoded keys.
MAX_CASCADE_WORDS = 2_000_000
#: Keys left after the last level that may be stated outright.
MAX_STATED = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, both as in the module's contract."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.char_length(text))).otherwise("")
    host = F.translate(
        F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as ``struct<rule, verdict>``, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_keys(host: Column, depth: int) -> list[Column]:
    """The host itself and its last 1 to ``depth`` labels; shorter hosts repeat themselves."""
    return [host, *[F.substring_index(host, ".", -i) for i in range(1, depth + 1)]]


def labels_of(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def parents(host: Column) -> Column:
    """The host and all its parent domains, however many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), labels_of(host)), lambda i: F.call_function("substring_index", host, F.lit("."), -i)))


def _hits(rows: DataFrame, cascade: Cascade) -> DataFrame:
    """Add ``_hit``: whether the host or a parent domain is listed.

    Hosts of few labels are answered in the row's own expression. Deeper ones
    are numbered, every parent is tested as a row, and the answers are grouped
    by number, so neither the plan nor the other rows grow with their depth.
    """
    few = labels_of(F.col("host")) <= UNROLLED
    hit = reduce(or_, [cascade.holds(k) for k in host_keys(F.col("host"), UNROLLED)])
    plain = rows.filter(few).withColumn("_hit", (F.col("host") != "") & hit)
    deep = rows.filter(~few)
    if deep.isEmpty():
        return plain
    deep = pin(deep.withColumn("_number", F.monotonically_increasing_id()))
    tested = deep.select("_number", F.explode(parents(F.col("host"))).alias("key")).select("_number", cascade.holds(F.col("key")).alias("_hit"))
    answers = tested.groupBy("_number").agg(F.bool_or("_hit").alias("_hit"))
    return plain.unionByName(deep.join(answers, "_number").drop("_number"))


def listed_hosts(keys: DataFrame, words=LISTED_WORDS) -> DataFrame:
    """Keys whose first label holds a listed word set off by hyphens."""
    first = F.split(F.regexp_extract("key", r"^[^.]*", 0), "-")
    return keys.filter(F.arrays_overlap(first, F.array(*[F.lit(w) for w in words])))


# --- cascade --------------------------------------------------------------


def _bit(key: Column, level: int, k: int, bits: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1000 * level + k)), bits)


def _encode(keys: DataFrame, level: int, n: int) -> DataFrame:
    """One row: the number of bits and the filter's words of 32 bits."""
    spark = keys.sparkSession
    bits = max(64, n * BITS_PER_KEY)
    width = F.lit(bits).cast("long")
    words = (
        keys.select(F.explode(F.array(*[_bit(F.col("key"), level, k, width) for k in range(HASHES)])).alias("b"))
        .select(F.floor(F.col("b") / 32).alias("w"), F.expr("shiftleft(1L, CAST(b % 32 AS INT))").alias("v"))
        .groupBy("w")
        .agg(F.bit_or("v").alias("v"))
    )
    # Every word is there, so that its place in the sorted list is its number.
    every = spark.range((bits + 31) // 32).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    full = words.unionByName(every).groupBy("w").agg(F.bit_or("v").alias("v"))
    return full.agg(F.sort_array(F.collect_list(F.struct("w", "v"))).alias("l")).select(
        F.struct(width.alias("bits"), F.transform("l", lambda x: x["v"]).alias("words")).alias("filter")
    )


def _in_filter(key: Column, level: int, held: Column) -> Column:
    test = F.lit(True)
    for k in range(HASHES):
        b = _bit(key, level, k, held["bits"])
        word = F.get(held["words"], F.floor(b / 32).cast("int"))
        test = test & (F.getbit(word, (b % 32).cast("int")) == 1)
    return test


@dataclass
class Cascade:
    """A frame of one row per level, and keys stated outright, if any are left."""

    levels: list[DataFrame]
    stated: list[str]

    def holds(self, key: Column) -> Column:
        """Membership for a key of the corpus. The levels enter as scalar subqueries."""
        last = len(self.levels)
        answer = F.lit(last % 2 == 1)
        for level in range(last, 0, -1):
            inside = _in_filter(key, level, self.levels[level - 1].scalar())
            answer = F.when(inside, answer).otherwise(F.lit(level % 2 == 0))
        if self.stated:
            # Keys that the last level still answers wrongly.
            answer = answer != key.isin(self.stated)
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """Exact filter of the distinct ``key``s of ``listed`` within ``universe``; None if it grows too large."""
    marked = universe.select("key", F.lit(False).alias("in_list")).unionByName(
        listed.select("key", F.lit(True).alias("in_list")).join(universe.select("key"), "key", "left_semi")
    )
    keys = pin(marked.groupBy("key").agg(F.max("in_list").alias("in_list")))
    wrong, others = keys.filter("in_list").select("key"), keys.filter(~F.col("in_list")).select("key")
    levels, total = [], 0
    while n := wrong.count():
        total += n * BITS_PER_KEY // 32 + 2
        if len(levels) == MAX_LEVELS or total > MAX_CASCADE_WORDS:
            break
        level = len(levels) + 1
        levels.append(pin(_encode(wrong, level, n)))
        # What the level passes although it encodes the other side is encoded next.
        passed = pin(others.filter(_in_filter(F.col("key"), level, levels[-1].scalar())))
        wrong, others = passed, wrong
    if n > MAX_STATED:
        return None
    return Cascade(levels, [r["key"] for r in wrong.collect()] if n else [])


# --- judging --------------------------------------------------------------


def judge_urls(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to rows with a ``url``.

    ``listed`` has the block list as ``key``, hosts or domains; without one, the
    corpus's own hosts with ``LISTED_WORDS`` are listed.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict") and not c.startswith("_")]
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(*kept, host.alias("host"), path.alias("path"))
    hosts = pin(parsed.select("host").distinct())
    named = hosts.filter(F.col("host") != "").select("host", F.explode(parents(F.col("host"))).alias("key"))
    universe = named.select("key").distinct()
    wanted = listed_hosts(universe) if listed is None else listed.select("key").filter(F.col("key").isNotNull())
    cascade = build_cascade(wanted, universe)
    if cascade is None:
        blocked = named.join(wanted, "key", "left_semi").select("host", F.lit(True).alias("_hit")).distinct()
        asked = parsed.join(blocked, "host", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    else:
        asked = _hits(parsed, cascade)
    ruled = asked.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    return ruled.select(
        *kept,
        "host",
        "path",
        F.col("_rule")["rule"].alias("rule"),
        F.coalesce(F.col("_rule")["verdict"], F.when(F.col("_hit"), "block").otherwise("allow")).alias("verdict"),
    )
