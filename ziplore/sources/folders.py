"""Folders listed and files read by tasks.

Spark's file sources leave out files of zero bytes and names that begin with
``_`` or ``.``; here every file counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ziplore.session import scratch_path
from ziplore.sources.archives import BATCH_BYTES, MAX_MEMBER_MB, MB, project_of
from ziplore.sources.ranges import RANGE_BYTES, deal
from ziplore.sources.storage import list_folder, qualified, resolve

#: What opening a file counts as when files are dealt to tasks.
OPEN_BYTES = 128 * 1024
#: Folders that a task lists, at least, where there are more folders than tasks.
FOLDERS_PER_TASK = 64

_LISTED = "uri string, size long"


def _list(folders: DataFrame, count: int, named: str | None = None) -> DataFrame:
    """Files and, with a null size, folders right below each folder; ``named`` is a pattern for their names."""
    matches = re.compile(named or "", re.S).fullmatch if named else lambda name: True
    tasks = min(count, max(2 * folders.sparkSession.sparkContext.defaultParallelism, math.ceil(count / FOLDERS_PER_TASK)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, inner = list_folder(uri)
                rows = [(u, n) for u, n in [*files, *((u, None) for u in inner)] if matches(u.rpartition("/")[2])]
                arrays = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["uri", "size"])

    return folders.repartition(max(1, tasks)).mapInArrow(look, _LISTED)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """``uri, size`` of every file below a folder.

    Folders are expanded level by level: the folders that one level finds are
    dealt to tasks anew for the next, so a large project is listed by many
    tasks however its folders nest. Each level is written to the shared folder.
    """
    base = scratch_path(spark, "walk")
    frontier, count, level = spark.createDataFrame([(qualified(spark, root),)], "uri string"), 1, 0
    while count:
        path = f"{base}/level={level}"
        _list(frontier, count).write.parquet(path)
        listed = spark.read.schema(_LISTED).parquet(path)
        frontier = listed.filter(F.col("size").isNull()).select("uri")
        count, level = frontier.count(), level + 1
    return spark.read.schema(f"{_LISTED}, level int").parquet(base).filter(F.col("size").isNotNull()).select("uri", "size")


def scan_project_dirs(
    spark: SparkSession, root: str, max_file_mb: float = MAX_MEMBER_MB, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Files of projects that are already unpacked below ``root``: ``project_id, rel_path, size_bytes, content``.

    The first segment below the root is the project. Listed files are dealt to
    tasks by their sizes and read once, in blocks; one that can't be read or is
    larger than the limit has no content, and so counts as binary.

    There is no member index here; :func:`ziplore.operators.triage.number_by_path`
    adds ``seq`` once the rows are narrow.
    """
    home = f"{qualified(spark, root).rstrip('/')}/"
    inner = F.substring(F.col("uri"), len(home) + 1, F.length("uri"))
    files = walk(spark, root).select(
        F.substring_index(inner, "/", 1).alias("project_id"),
        F.substring(inner, F.locate("/", inner) + 1, F.length(inner)).alias("rel_path"),
        "uri",
        "size",
    ).filter(F.locate("/", inner) > 0)
    limit = int(max_file_mb * MB)
    dealt = deal(files, F.least("size", F.lit(limit)), OPEN_BYTES, range_bytes)
    return dealt.mapInArrow(_reader(limit), _FILE_BYTES)


_FILE_BYTES = "project_id string, rel_path string, size_bytes long, content binary"


def read_bounded(uri: str, limit: int) -> bytes | None:
    """The whole file, or None if it is longer than the limit or can't be read."""
    try:
        system, path = resolve(uri)
        with system.open_input_stream(path) as source:
            content = source.read(limit + 1)
    except OSError:
        return None
    return content if len(content) <= limit else None


def _reader(limit: int) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for project, inner, uri, length in zip(*(c.to_pylist() for c in batch.columns)):
                content = read_bounded(uri, limit) if length <= limit else None
                held.append((project, inner, length if content is None else len(content), content))
                size += len(content or b"")
                if size >= BATCH_BYTES or len(held) >= 4096:
                    yield _file_batch(held)
                    held, size = [], 0
        if held:
            yield _file_batch(held)

    return read


def _file_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.binary()]
    arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(arrays, ["project_id", "rel_path", "size_bytes", "content"])


def upload_homes(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a path or pattern, as URIs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or ()
    return [f.getPath().toString() for f in found if f.isDirectory()]


def list_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Path, project and size of every upload, also those that Spark's file sources leave out.

    ``folder`` may end in a pattern. Only the folder before the pattern's last
    segment is looked up on the driver; what is in it, and in the folders that
    match, is listed by tasks.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = qualified(spark, folder).rstrip("/")
    if re.search(r"[*?\[{]", where):
        above, _, last = where.rpartition("/")
        named = hadoop.GlobPattern(last).compiled().pattern()
    else:
        above, named = where, None
    homes = [(home,) for home in upload_homes(spark, above)]
    start = spark.createDataFrame(homes, "uri string")
    listed = _list(start, max(1, len(homes)), named)
    if named:
        path = scratch_path(spark, "uploads")
        listed.write.parquet(path)
        listed = spark.read.schema(_LISTED).parquet(path)
        inner = listed.filter(F.col("size").isNull()).select("uri")
        listed = listed.unionByName(_list(inner, max(1, inner.count())))
    uploads = listed.filter(F.col("size").isNotNull() & F.lower("uri").endswith(".zip"))
    return uploads.select(F.col("uri").alias("path"), project_of(F.col("uri"), folder).alias("project_id"), F.col("size").alias("length"))
