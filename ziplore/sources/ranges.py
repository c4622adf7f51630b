"""Archives read by ranges of members.

A task that plans opens an archive as a stream it can seek in and reads the
directory at its end, nothing else. Guards on declared sizes and paths are
answered there. The members of an acceptable archive are cut into ranges of
about ``RANGE_BYTES`` unpacked; ranges, not archives, are dealt to tasks, and each
reads its members from where they lie. So no archive is held whole, a large one
is read by many tasks, and a task holds one member and one batch.

An archive is released whole or not at all. ``open_by_range`` checks every range
first and then reads only those of sound archives; ``read_ranges`` reads once and
gives faults as rows, for plans that let go of content in the same task and drop
what belongs to faulty archives afterwards, on narrow rows.
"""

from __future__ import annotations

import math
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ziplore.operators.joins import anti_join
from ziplore.schemas import OPENED
from ziplore.session import pin
from ziplore.sources.archives import (
    BAD_CHECKSUM,
    MAX_MEMBER_MB,
    MB,
    NOT_A_ZIP,
    declared_fault,
    encodable,
    landing_path,
    opened_batches,
)
from ziplore.sources.storage import open_seekable

RANGE_BYTES = 64 * MB
RANGE_MEMBERS = 10_000
#: What opening a range counts as when ranges are dealt to tasks.
OPEN_BYTES = 2 * MB
READ_BYTES = 1 * MB

PLAN = (
    "project_id string, path string, range int, first long, last long, size_bytes long, reject_reason string"
)
_PLAN_FIELDS = [f.split(" ") for f in PLAN.split(", ")]
_ARROW_PLAN = pa.schema(
    [(name, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[kind]) for name, kind in _PLAN_FIELDS]
)


def member_ranges(
    infos: list[zipfile.ZipInfo], range_bytes: int, range_members: int = RANGE_MEMBERS
) -> Iterator[tuple[int, int, int]]:
    """``(first, last, bytes)`` of consecutive directory entries; an empty archive has one range without entries."""
    first, size = 0, 0
    for seq, info in enumerate(infos):
        if seq > first and (size + info.file_size > range_bytes or seq - first >= range_members):
            yield first, seq - 1, size
            first, size = seq, 0
        size += info.file_size
    yield first, len(infos) - 1, size


def planned(project: str, path: str, max_member_bytes: int | None, range_bytes: int) -> Iterator[tuple]:
    """Rows of the plan for one archive: its ranges, or one row with the reason it is turned away."""
    try:
        with open_seekable(path) as stream:
            if not zipfile.is_zipfile(stream):
                yield project, path, None, None, None, None, NOT_A_ZIP
                return
            infos = zipfile.ZipFile(stream).infolist()
    except Exception as error:  # gone, unreadable, broken directory
        yield project, path, None, None, None, None, f"Unreadable archive: {error}"
        return
    if max_member_bytes is not None:
        reason = next((r for r in (declared_fault(i, max_member_bytes) for i in infos) if r), None)
        if reason:
            yield project, path, None, None, None, None, reason
            return
    for number, (first, last, size) in enumerate(member_ranges(infos, range_bytes)):
        yield project, path, number, first, last, size, None


def plan_ranges(
    archives: DataFrame, max_member_mb: float | None = MAX_MEMBER_MB, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Pinned ranges of every archive of ``(project_id, path)``.

    Every archive has at least one row; one that is turned away has a null
    ``range`` and the reason.
    """
    limit = None if max_member_mb is None else int(max_member_mb * MB)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for project, path in zip(*(c.to_pylist() for c in batch.columns)):
                rows = list(planned(project, path, limit, range_bytes))
                arrays = [pa.array([encodable(v) for v in column], kind.type) for column, kind in zip(zip(*rows), _ARROW_PLAN)]
                yield pa.RecordBatch.from_arrays(arrays, names=_ARROW_PLAN.names)

    return pin(archives.select("project_id", "path").mapInArrow(plan, PLAN))


def deal(rows: DataFrame, size: Column, open_bytes: int, task_bytes: int) -> DataFrame:
    """Narrow rows that stand for work, spread evenly over as many tasks as their bytes ask for.

    The number is given, as adaptive execution would put few small rows back
    into one task. Opening one counts as ``open_bytes``.
    """
    total, n = rows.agg(F.sum(size), F.count(F.lit(1))).first()
    return rows.repartition(max(1, min(n, math.ceil(((total or 0) + n * open_bytes) / task_bytes))))


def range_rows(
    project: str, path: str, first: int, last: int, max_member_bytes: int | None, dedupe: bool, contents: bool
) -> Iterator[tuple]:
    """Members of one range in the opened model, or the first fault, with the number of the member that has it."""
    seq, name = first, None
    try:
        with open_seekable(path) as stream:
            archive = zipfile.ZipFile(stream)
            infos = archive.infolist()
            latest = {landing_path(i.filename): n for n, i in enumerate(infos) if not i.is_dir()} if contents else {}
            for seq in range(first, last + 1):
                info = infos[seq]
                name, place = info.filename, landing_path(info.filename)
                wanted = contents and not info.is_dir() and place and (not dedupe or latest[place] == seq)
                with archive.open(info) as member:
                    if wanted:
                        # The declared size bounds the read: a header that lies fails the checksum.
                        content = member.read(max_member_bytes + 1)
                        yield project, seq, name, place, info.file_size, content, None
                    else:
                        while member.read(READ_BYTES):
                            pass
    except zipfile.BadZipFile:
        yield project, seq, name, None, None, None, f"{BAD_CHECKSUM}{name}"
    except Exception as error:  # encrypted or unsupported members, a file that is gone
        yield project, seq, name, None, None, None, f"Unreadable archive: {error}"


def read_ranges(
    plan: DataFrame,
    max_member_mb: float | None = MAX_MEMBER_MB,
    dedupe: bool = True,
    contents: bool = True,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Read every range once, in the opened model.

    A marker row (null ``seq``) per archive carries the reason of the plan. A
    member that can't be read gives a row with its ``seq`` and ``reject_reason``:
    its archive is unsound, and what was read of it must not be used. With
    ``contents`` off members are only checked.
    """
    if contents and max_member_mb is None:
        raise ValueError("members are only released under a size limit")
    limit = None if max_member_mb is None else int(max_member_mb * MB)

    def rows_of(project, path, number, first, last, _, reason) -> Iterator[tuple]:
        if not number:
            yield project, None, None, None, None, None, reason
        if number is not None:
            yield from range_rows(project, path, first, last, limit, dedupe, contents)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from opened_batches(
            row
            for batch in batches
            for planned_row in zip(*(c.to_pylist() for c in batch.columns))
            for row in rows_of(*planned_row)
        )

    return deal(plan, F.col("size_bytes"), OPEN_BYTES, range_bytes).mapInArrow(read, OPENED)


def first_faults(opened: DataFrame) -> DataFrame:
    """``project_id, reject_reason`` of archives with a fault: the plan's, else that of the first member that has one."""
    return (
        opened.filter(F.col("reject_reason").isNotNull())
        .groupBy("project_id")
        .agg(F.min_by("reject_reason", F.coalesce("seq", F.lit(-1))).alias("reject_reason"))
    )


def range_faults(
    archives: DataFrame, max_member_mb: float | None = MAX_MEMBER_MB, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """One row per archive with its ``reject_reason`` (null when sound), read once.

    With ``max_member_mb=None`` only format and checksums are checked.
    """
    opened = read_ranges(plan_ranges(archives, max_member_mb, range_bytes), max_member_mb, contents=False, range_bytes=range_bytes)
    return opened.groupBy("project_id").agg(
        F.expr("min_by(reject_reason, coalesce(seq, -1)) FILTER (WHERE reject_reason IS NOT NULL)").alias("reject_reason")
    )


def open_by_range(
    archives: DataFrame,
    max_member_mb: float = MAX_MEMBER_MB,
    dedupe: bool = True,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Like ``open_archives``, for ``(project_id, path)``: marker rows, and members of sound archives.

    Ranges are checked first, then those of sound archives are read.
    """
    plan = plan_ranges(archives, max_member_mb, range_bytes)
    checked = read_ranges(plan, max_member_mb, contents=False, range_bytes=range_bytes)
    faults = pin(first_faults(checked))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in OPENED.fields[1:-1]]
    markers = faults.select("project_id", *empty, "reject_reason")
    return markers.unionByName(read_ranges(anti_join(plan, faults, ["project_id"], "path"), max_member_mb, dedupe, range_bytes=range_bytes))


def explode_by_range(
    archives: DataFrame, max_member_mb: float = MAX_MEMBER_MB, dedupe: bool = True, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """One row per file member of every sound archive of ``(project_id, path)``."""
    opened = open_by_range(archives, max_member_mb, dedupe, range_bytes)
    return opened.filter(F.col("seq").isNotNull() & F.col("reject_reason").isNull()).drop("reject_reason")
