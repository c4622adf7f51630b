"""Sinks for finished artefacts and per-file results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_artifacts(
    artifacts: DataFrame, path: str, fmt: str = "json", buckets: int = 16, mode: str = "overwrite"
) -> None:
    """One object ``{tree_text, file_summaries, project_summary}`` per project part.

    Files are laid out in hash buckets of ``(project_id, part)``, which spreads
    the parts of a large project. Rows are rebalanced by bucket first: Spark
    splits large buckets and merges small ones, so files come out even.
    """
    bucket = F.pmod(F.xxhash64("project_id", "part"), F.lit(buckets)).cast("int")
    laid_out = artifacts.withColumn("bucket", bucket).hint("rebalance", "bucket")
    laid_out.write.mode(mode).partitionBy("bucket").format(fmt).save(path)


def write_file_summaries(results: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """The flat per-file result table."""
    wanted = ("project_id", "rank", "rel_path", "kind", "summary", "lines", "size_bytes", "language")
    present = [c for c in wanted if c in results.columns]
    results.select(*present).write.mode(mode).format(fmt).save(path)
