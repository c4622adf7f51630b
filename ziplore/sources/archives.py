"""Archives as rows: listing, scanning and opening whole archives.

:mod:`ziplore.sources.ranges` reads archives that tasks can open on their own,
large ones by several tasks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ziplore.schemas import ARCHIVE_SCAN, OPENED

# Why an archive is turned away.
NOT_THERE = "File does not exist"
NOT_A_ZIP = "Not a ZIP archive"
BAD_CHECKSUM = "CRC error in member: "
OUTSIDE_ROOT = "Illegal member path: "

ZIP_GLOB = "*.[zZ][iI][pP]"
MB = 1_048_576
MAX_ARCHIVE_MB = 300
MAX_MEMBER_MB = 150

# Members are handed on in batches of about this size, so one large archive
# never sits in memory unpacked.
BATCH_BYTES = 16 * MB
BATCH_ROWS = 4096

_ARROW_OPENED = pa.schema([
    ("project_id", pa.string()),
    ("seq", pa.int64()),
    ("member_name", pa.string()),
    ("rel_path", pa.string()),
    ("size_bytes", pa.int64()),
    ("content", pa.binary()),
    ("reject_reason", pa.string()),
])


def project_of(path: Column, folder: str) -> Column:
    """The archive's path below the scanned folder, without ``.zip``.

    Equal names in two sub-folders are two projects. The folder is what comes
    before the first wildcard; an archive outside it is known by its name.
    """
    fixed = re.split(r"[*?\[{]", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*|^file:", "", folder), maxsplit=1)
    root = fixed[0] if len(fixed) == 1 else fixed[0].rpartition("/")[0]
    root = f"{root.rstrip('/')}/"
    at = F.locate(root, path)
    below = F.when(at > 0, F.substring(path, at + len(root), F.length(path))).otherwise(F.substring_index(path, "/", -1))
    return F.regexp_replace(below, r"[.][zZ][iI][pP]\z", "")


def project_label(project_id: Column) -> Column:
    """Last segment of a project's id, for display."""
    return F.substring_index(project_id, "/", -1)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Path, project and compressed size of every archive; no content is read.

    Spark's file sources leave out files of zero bytes, so an empty upload
    looks like a missing one.
    """
    scan = spark.read.format("binaryFile").option("pathGlobFilter", ZIP_GLOB).load(folder)
    return scan.select("path", project_of(F.col("path"), folder).alias("project_id"), "length")


def scan_archives(spark: SparkSession, folder: str, max_mb: float = MAX_ARCHIVE_MB) -> DataFrame:
    """One row per archive within the size limit.

    The limit is a filter on ``length`` that the source evaluates on the file
    listing, so oversized archives are never opened.
    """
    scan = spark.read.format("binaryFile").option("pathGlobFilter", ZIP_GLOB).load(folder)
    return _archive_rows(scan, folder, max_mb)


def stream_archives(
    spark: SparkSession,
    folder: str,
    max_mb: float = MAX_ARCHIVE_MB,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Each archive that appears below ``folder``, once."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(ARCHIVE_SCAN)
        .option("pathGlobFilter", ZIP_GLOB)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _archive_rows(reader.load(folder), folder, max_mb)


def _archive_rows(scan: DataFrame, folder: str, max_mb: float) -> DataFrame:
    return scan.filter(F.col("length") <= int(max_mb * MB)).select(
        "path", project_of(F.col("path"), folder).alias("project_id"), "length", "content"
    )


def _leaves_root(name: str) -> bool:
    depth = 0
    for segment in name.split("/"):
        depth += {"..": -1, "": 0, ".": 0}.get(segment, 1)
        if depth < 0:
            return True
    return name.startswith("/")


def landing_path(name: str) -> str:
    return "/".join(s for s in name.split("/") if s not in ("", ".", ".."))


def declared_fault(info: zipfile.ZipInfo, max_member_bytes: int) -> str | None:
    """Why a member is not acceptable by its directory entry: size before path."""
    if info.file_size > max_member_bytes:
        return f"Member {info.filename} exceeds {max_member_bytes / MB:g} MB"
    if _leaves_root(info.filename):
        return OUTSIDE_ROOT + info.filename
    return None


def _fault(archive: zipfile.ZipFile, max_member_bytes: int | None) -> str | None:
    """First reason to turn an archive away, or None.

    What the directory declares is looked at first, so nothing of an archive
    with an oversized member is unpacked. Then all members are read once, in
    blocks. Without a member limit only the checksums are checked.
    """
    if max_member_bytes is not None:
        for info in archive.infolist():
            reason = declared_fault(info, max_member_bytes)
            if reason is not None:
                return reason
    corrupt = archive.testzip()
    return None if corrupt is None else BAD_CHECKSUM + corrupt


def _archive_rows_of(project: str, blob: bytes, max_member_bytes: int | None, dedupe: bool, members: bool):
    """Marker row of one archive, then its members when it is sound."""
    source = io.BytesIO(blob)
    if not zipfile.is_zipfile(source):
        yield (project, None, None, None, None, None, NOT_A_ZIP)
        return
    try:
        archive = zipfile.ZipFile(source)
        reason = _fault(archive, max_member_bytes)
    except Exception as error:  # encrypted or unsupported members, broken directory
        yield (project, None, None, None, None, None, f"Unreadable archive: {error}")
        return
    yield (project, None, None, None, None, None, reason)
    if reason is not None or not members:
        return
    entries = [
        (seq, info, landing_path(info.filename))
        for seq, info in enumerate(archive.infolist())
        if not info.is_dir()
    ]
    last = {path: seq for seq, _, path in entries}
    for seq, info, path in entries:
        if not path or (dedupe and last[path] != seq):
            continue
        with archive.open(info) as member:
            # The declared size bounds the read: a header that lies fails the CRC.
            content = member.read(max_member_bytes + 1)
        yield (project, seq, info.filename, path, info.file_size, content, None)


def encodable(value):
    return value.encode("utf-8", "replace").decode("utf-8") if isinstance(value, str) else value


def opened_batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of the opened model in batches of bounded size."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        arrays = [
            pa.array([encodable(v) for v in column], type=field.type)
            for column, field in zip(zip(*held), _ARROW_OPENED)
        ]
        return pa.RecordBatch.from_arrays(arrays, names=_ARROW_OPENED.names)

    for row in rows:
        held.append(row)
        size += len(row[5] or b"")
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def open_archives(
    archives: DataFrame,
    max_member_mb: float | None = MAX_MEMBER_MB,
    dedupe: bool = True,
    members: bool = True,
) -> DataFrame:
    """Unpack ``(project_id, content)`` archives into member rows and marker rows.

    Every archive gives one marker row (null ``seq``) with the reason it was
    turned away, or null. A sound archive then gives one row per file member;
    an unsound one releases nothing. Among members that land on one path the
    last wins. The step is stateless, so it also runs on streams.
    """
    if members and max_member_mb is None:
        raise ValueError("members are only released under a size limit")
    max_member_bytes = None if max_member_mb is None else int(max_member_mb * MB)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from opened_batches(
            row
            for batch in batches
            for project, blob in zip(batch.column(0), batch.column(1))
            for row in _archive_rows_of(project.as_py(), blob.as_py() or b"", max_member_bytes, dedupe, members)
        )

    return archives.select("project_id", "content").mapInArrow(unpack, OPENED)


def explode_members(
    archives: DataFrame, max_member_mb: float = MAX_MEMBER_MB, dedupe: bool = True
) -> DataFrame:
    """One row per file member of every sound archive."""
    opened = open_archives(archives, max_member_mb, dedupe)
    return opened.filter(F.col("seq").isNotNull()).drop("reject_reason")


def archive_faults(archives: DataFrame, max_member_mb: float | None = MAX_MEMBER_MB) -> DataFrame:
    """One row per archive with its ``reject_reason`` (null when sound).

    With ``max_member_mb=None`` only format and checksums are checked.
    """
    opened = open_archives(archives, max_member_mb, members=False)
    return opened.select("project_id", "reject_reason")
