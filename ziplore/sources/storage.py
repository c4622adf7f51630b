"""Files as tasks see them: seekable streams and folder listings through Arrow's file systems."""

from __future__ import annotations

import io
import os
import re

from pyspark.sql import SparkSession

#: How the names of stores are spelled for Spark and for Arrow. Stores that are
#: not listed are read through Spark's own sources, whole files at a time.
SCHEMES = {
    "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss",
}
BUFFER_BYTES = 1 << 20

_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)?\Z", re.S)
_systems: dict = {}


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme; a bare path is one of the default file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def scheme_of(uri: str) -> str:
    found = _URI.match(uri)
    return found[1].lower() if found else "file"


def streamable(uri: str) -> bool:
    """Whether tasks can open the store on their own."""
    return scheme_of(uri) in SCHEMES


def resolve(uri: str):
    """Arrow's file system for a URI as Spark writes it, and the path there.

    Spark writes names as they are, so the path is not decoded.
    """
    from pyarrow import fs

    found = _URI.match(uri)
    scheme, authority, path = (found[1].lower(), found[2] or "", found[3] or "/") if found else ("file", "", uri)
    if scheme == "file":
        return fs.LocalFileSystem(), path
    key = scheme, authority
    if key not in _systems:
        system, base = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{authority}/")
        _systems[key] = system, base.rstrip("/")
    system, base = _systems[key]
    return system, f"{base}{path}"


class _Raw(io.RawIOBase):
    """Arrow's file as Python's readers expect one: a place before the start is an ``OSError``."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        return self.file.readinto(buffer)

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        place = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.file.tell(), io.SEEK_END: self.file.size()}[whence]
        if place < 0:
            raise OSError(f"seek to {place}")
        return self.file.seek(place)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


def open_seekable(uri: str) -> io.BufferedReader:
    """A buffered stream that can seek; nothing is read ahead of need but one buffer."""
    system, path = resolve(uri)
    return io.BufferedReader(_Raw(system.open_input_file(path)), BUFFER_BYTES)


def list_files(uri: str) -> list[tuple[str, int, int]]:
    """``(URI, size, time of last change in ms)`` of the files right below a folder; none if it is gone."""
    from pyarrow import fs

    system, path = resolve(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return [
        (f"{uri.rstrip('/')}/{f.base_name}", f.size, (f.mtime_ns or 0) // 1_000_000) for f in found if f.type == fs.FileType.File
    ]


def list_folder(uri: str) -> tuple[list[tuple[str, int]], list[str]]:
    """``(files with sizes, folders)`` right below a folder, as URIs. Links to folders are not followed."""
    from pyarrow import fs

    system, path = resolve(uri)
    local = isinstance(system, fs.LocalFileSystem)
    files, folders = [], []
    for found in system.get_file_info(fs.FileSelector(path)):
        child = f"{uri.rstrip('/')}/{found.base_name}"
        if found.type == fs.FileType.File:
            files.append((child, found.size))
        elif found.type == fs.FileType.Directory and not (local and os.path.islink(found.path)):
            folders.append(child)
    return files, folders
