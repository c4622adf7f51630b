"""Quality rules: statistics of whole texts and robust multivariate outliers.

Everything is built from DataFrame functions. A text is first measured in the
task that reads it; only numbers go on. Per language and source a minimum
covariance determinant estimate is made over transformed statistics by
concentration steps: centre and scatter of the nearest rows, new distances,
again. Each step is one grouping with partial sums, so a source with a third of
all rows is pre-aggregated before the shuffle.

Defined results: a null text counts as empty; repeated rows are judged each;
null language or source form groups of their own; a group of fewer than
``MIN_GROUP`` rows takes the estimate over its whole language, or over all rows
where that is as small; texts without a word are judged by the fixed rules only;
an empty table gives an empty result. Columns of the input that clash with
those added are replaced, those that begin with an underscore are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ziplore.operators.joins import join_measured
from ziplore.session import pin

WORD = r"[^\x20\x09-\x0D]+"
SEPARATOR = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Share of a group's rows the determinant is minimised over.
CORE_SHARE = 0.75
CONCENTRATION_STEPS = 3
MIN_GROUP = 40
#: Squared distance beyond which a text is rejected: ten robust standard
#: deviations. Text statistics have far heavier tails than the normal law, so
#: its usual quantile of 0.975 would reject sound texts, tables for one.
CUTOFF = 100.0
#: Least standard deviation of each transformed statistic. Most texts have no
#: symbol and no repeated line at all, which would make the scatter singular.
FEATURES = {"f_length": 0.08, "f_symbols": 0.30, "f_lines": 0.30, "f_repeats": 0.30}
#: Scatter of the nearest CORE_SHARE of normal rows in 4 dimensions, as a share
#: of the full scatter: P(chi2_6 <= q) / 0.75 with P(chi2_4 <= q) = 0.75.
CONSISTENCY = 0.6718


def text_statistics(docs: DataFrame) -> DataFrame:
    """Word, line and repetition counts of every text; the text itself is dropped."""
    text = F.coalesce(F.col("text"), F.lit(""))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in docs.columns if c != "text" and c not in added and not c.startswith("_")]
    words = docs.select(
        *kept,
        text.alias("_text"),
        F.filter(F.split(text, SEPARATOR, -1), lambda w: w != "").alias("_words"),
    )
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))
    counted = words.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", SYMBOLS, "")))
        .cast("long")
        .alias("n_symbols"),
        F.when(F.contains("_text", F.lit("\n")), lines).alias("_lines"),
        F.when(
            F.size("_words") > WINDOW,
            F.transform(
                F.slice("_words", 1, F.size("_words") - (WINDOW - 1)),
                lambda _, i: F.xxhash64(F.slice("_words", i + 1, WINDOW)),
            ),
        ).alias("_windows"),
    )
    repeated = counted.withColumn(
        "_ranked",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    again = repeated.withColumn(
        "_again",
        F.sort_array(
            F.filter(
                F.transform(
                    "_ranked",
                    lambda x, k: F.when(
                        F.coalesce(x["h"] == F.get("_ranked", k - 1)["h"], F.lit(False))
                        | F.coalesce(x["h"] == F.get("_ranked", k + 1)["h"], F.lit(False)),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
        ),
    )
    covered = F.aggregate(
        F.transform(
            "_again",
            lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_again", k + 1) - p, F.lit(WINDOW))),
        ),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    return again.select(
        *kept,
        "n_words",
        "word_chars",
        "n_symbols",
        F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0))
        .cast("long")
        .alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def fails_base(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _features() -> list[Column]:
    """Transformed statistics: logarithms, so that shares compare as ratios."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("f_length"),
        F.log1p(20 * F.col("n_symbols") / n).alias("f_symbols"),
        F.log1p(20 * F.col("n_dup_lines") / n).alias("f_lines"),
        F.log1p(20 * F.col("n_repeat_words") / n).alias("f_repeats"),
    ]


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor."""
    solved: list[Column] = []
    total = F.lit(0.0)
    for i, name in enumerate(names):
        rest = F.col(name) - F.col("fit")[f"m_{i}"]
        for j in range(i):
            rest = rest - F.col("fit")[f"l_{i}_{j}"] * solved[j]
        solved.append(rest / F.col("fit")[f"l_{i}_{i}"])
        total = total + solved[-1] * solved[-1]
    return total


def _fits(rows: DataFrame, names: list[str], scale: float) -> DataFrame:
    """Centre and Cholesky factor of the scatter per group, as struct ``fit``."""
    d = len(names)
    moments = rows.groupBy("_lang", "_source").agg(
        *[F.avg(n).alias(f"m_{i}") for i, n in enumerate(names)],
        *[
            F.covar_pop(names[i], names[j]).alias(f"s_{i}_{j}")
            for i in range(d)
            for j in range(i + 1)
        ],
    )
    for i, name in enumerate(names):
        moments = moments.withColumn(
            f"s_{i}_{i}", F.col(f"s_{i}_{i}") / scale + F.lit(FEATURES[name] ** 2)
        )
        for j in range(i):
            moments = moments.withColumn(f"s_{i}_{j}", F.col(f"s_{i}_{j}") / scale)
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"s_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            if i == j:
                rest = F.sqrt(F.greatest(rest, F.lit(FEATURES[names[i]] ** 2 / 4)))
            else:
                rest = rest / F.col(f"l_{j}_{j}")
            moments = moments.withColumn(f"l_{i}_{j}", rest)
    parts = [f"m_{i}" for i in range(d)] + [f"l_{i}_{j}" for i in range(d) for j in range(i + 1)]
    return moments.select("_lang", "_source", F.struct(*parts).alias("fit"))


def _measured(rows: DataFrame, fits: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    joined = join_measured(rows, fits, ["_lang", "_source"], "_row", how)
    return joined.withColumn("_d2", _distance(names)).drop("fit")


def _levels(sound: DataFrame) -> DataFrame:
    """Per group whose estimate it takes, ``_takes``, and all estimates that its rows enter, ``_enters``."""
    sizes = pin(sound.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n")))
    languages = pin(sizes.groupBy("_lang").agg(F.sum("_n").alias("_of"), F.min("_n").alias("_least")))
    rest = not languages.filter(F.col("_of") < MIN_GROUP).isEmpty()
    # Names of languages and sources are empty or begin with "=".
    of = lambda lang, source: F.struct(lang.alias("_lang"), source.alias("_source"))
    own, language = of(F.col("_lang"), F.col("_source")), of(F.col("_lang"), F.lit("*"))
    every = of(F.lit("*"), F.lit("*"))
    large, spoken = F.col("_n") >= MIN_GROUP, F.col("_of") >= MIN_GROUP
    entered = F.array(F.when(large, own), F.when(spoken & (F.col("_least") < MIN_GROUP), language), F.when(F.lit(rest), every))
    return sizes.join(languages, "_lang").select(
        "_lang",
        "_source",
        F.when(large, own).when(spoken, language).otherwise(every).alias("_takes"),
        F.filter(entered, lambda e: e.isNotNull()).alias("_enters"),
    )


def robust_verdicts(stats: DataFrame) -> DataFrame:
    """Add ``distance`` (squared, null for a text without a word) and ``kept``.

    The first centre is the median and the first scatter the interquartile
    range of each statistic; every further step keeps the nearest
    ``CORE_SHARE`` of a group.
    """
    names = list(FEATURES)
    tagged = stats.drop("base_failed", "kept", "distance").select(
        "*",
        fails_base(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"),
        *_features(),
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("_lang"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = pin(tagged)
    sound = rows.filter("n_words > 0").select("_row", "_lang", "_source", *names)
    group = ["_lang", "_source"]
    levels = pin(_levels(sound))
    entering = join_measured(sound, levels.drop("_takes"), group, "_row").select("_row", F.explode("_enters").alias("_to"), *names)
    sound = pin(entering.select("_row", "_to.*", *names))
    start = sound.groupBy(*group).agg(
        *[F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, n in enumerate(names)]
    )
    fit = F.struct(
        *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(len(names))],
        *[
            (
                F.sqrt(
                    F.pow((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, 2)
                    + F.lit(FEATURES[names[i]] ** 2)
                )
                if i == j
                else F.lit(0.0)
            ).alias(f"l_{i}_{j}")
            for i in range(len(names))
            for j in range(i + 1)
        ],
    )
    fits = start.select(*group, fit.alias("fit"))
    for _ in range(CONCENTRATION_STEPS):
        measured = pin(_measured(sound, fits, names))
        limits = measured.groupBy(*group).agg(
            F.percentile_approx("_d2", CORE_SHARE, 1000).alias("_limit")
        )
        core = join_measured(measured, limits, group, "_row").filter("_d2 <= _limit")
        fits = pin(_fits(core, names, CONSISTENCY))
    taken = levels.select(*group, F.col("_takes._lang").alias("_of_lang"), F.col("_takes._source").alias("_of_source"))
    fits = taken.join(
        fits.withColumnsRenamed({"_lang": "_of_lang", "_source": "_of_source"}), ["_of_lang", "_of_source"]
    ).select(*group, "fit")
    judged = _measured(rows, pin(fits), names, "left")
    return judged.select(
        *[c for c in stats.columns if c not in ("base_failed", "kept", "distance")],
        "base_failed",
        F.when(F.col("n_words") > 0, F.col("_d2")).alias("distance"),
        (~F.col("base_failed") & (F.coalesce("_d2", F.lit(0.0)) <= CUTOFF)).alias("kept"),
    )


def judge_documents(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but the text, with statistics and verdict."""
    return robust_verdicts(text_statistics(docs))
