"""Per-file analysis: kind, one-line summary and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ziplore.functions.kinds import is_asset, language_of
from ziplore.functions.parsers import custom_summary, parsed_summary
from ziplore.functions.text import byte_count, decode_text, line_count, strip, summarise_stripped

ASSET_SUMMARY = "(binary skipped)"
PARSED_FORMATS = {"json": (".json",), "yaml": (".yml", ".yaml"), "python": (".py",)}


def with_text(files: DataFrame, **options) -> DataFrame:
    """Add the decoded ``text``."""
    return files.withColumn("text", decode_text(F.col("content"), **options))


def with_metrics(files: DataFrame) -> DataFrame:
    """Add ``lines``, ``size_bytes`` and ``language``. Needs content and name parts."""
    return files.withColumns(
        {
            "lines": line_count(F.col("content")),
            "size_bytes": byte_count(F.col("content")),
            "language": language_of(F.col("ext"), F.col("stem")),
        }
    )


def analyse_files(files: DataFrame, analyzers: dict[str, Callable] | None = None) -> DataFrame:
    """Add ``kind`` and ``summary`` to rows with ``ext`` and ``text``.

    The text summary is worked out first, in the JVM, for every row: what then
    goes past the parser UDF is one line per file, and text only for the rows
    of a parsed format, the rest being null. The input is read once.
    ``analyzers`` maps an extension to a function from text to ``(kind,
    summary)`` or None; it goes before the built-in rules.
    """
    ext, text = F.col("ext"), F.col("text")
    fmt = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, extensions in PARSED_FORMATS.items():
        fmt = fmt.when(ext.isin(*extensions), name)
    rows = files.withColumns({"_fmt": fmt, "_body": strip(text)}).withColumns(
        {"_plain": summarise_stripped(F.col("_body")), "_source": F.when(F.col("_fmt").isNotNull(), text)}
    )
    rows = rows.withColumn("_parsed", parsed_summary(F.col("_fmt"), F.col("_source")))
    parsed, asset = F.col("_source").isNotNull() & F.col("_parsed").isNotNull(), is_asset(ext)
    kind = F.when(asset, F.lit("asset")).when(parsed, F.col("_fmt")).otherwise(F.lit("text"))
    summary = (
        F.when(asset, F.lit(ASSET_SUMMARY)).when(parsed, F.col("_parsed")).otherwise(F.col("_plain"))
    )
    if analyzers:
        rows = rows.withColumn("_custom", custom_summary(ext, text, analyzers))
        taken = F.col("_custom.summary").isNotNull()
        kind = F.when(taken, F.col("_custom.kind")).otherwise(kind)
        summary = F.when(taken, F.col("_custom.summary")).otherwise(summary)
    helpers = ("_fmt", "_body", "_plain", "_source", "_parsed", "_custom")
    return rows.withColumns({"kind": kind, "summary": summary}).drop(*helpers)
