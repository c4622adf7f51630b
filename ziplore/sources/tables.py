"""Any table of texts or bytes as the ``files`` model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ziplore.functions.paths import stored_path
from ziplore.functions.text import byte_count


def files_from_table(
    df: DataFrame,
    project_id: Column | str,
    seq: Column | str,
    path: Column | str,
    content: Column | str,
) -> DataFrame:
    """Project a table to ``project_id, seq, rel_path, size_bytes, content``."""
    columns = {"project_id": project_id, "seq": seq, "path": path, "content": content}
    cols = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    body = cols["content"].cast("binary")
    return df.select(
        cols["project_id"].cast("string").alias("project_id"),
        cols["seq"].cast("long").alias("seq"),
        stored_path(cols["path"]).alias("rel_path"),
        byte_count(body).alias("size_bytes"),
        body.alias("content"),
    )
