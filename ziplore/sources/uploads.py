"""Uploads as a stream of names, also those that Spark's file sources leave out.

A micro-batch is a stretch of time: tasks list the folders and give the files that
were last changed in it. So each upload comes once for each time it is written,
files of zero bytes and hidden names included, nothing has to be remembered but
the time, and no list of uploads goes through the driver.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ziplore.sources.archives import project_of
from ziplore.sources.folders import upload_homes
from ziplore.sources.storage import list_files


class _Folder(InputPartition):
    def __init__(self, uri: str, after: int, until: int):
        self.uri, self.after, self.until = uri, after, until


class _UploadReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.homes, self.settled = json.loads(options["homes"]), int(options["settle_ms"])

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        # The millisecond that has begun may still bring files.
        return {"ms": int(time.time() * 1000) - 1 - self.settled}

    def partitions(self, start: dict, end: dict) -> list[_Folder]:
        return [_Folder(home, start["ms"], end["ms"]) for home in self.homes]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for uri, size, changed in list_files(partition.uri):
            if partition.after < changed <= partition.until and uri.lower().endswith(".zip"):
                yield uri, size, changed


class UploadSource(DataSource):
    """Files ending in ``.zip`` right below some folders: ``path, length, changed_ms``."""

    @classmethod
    def name(cls) -> str:
        return "ziplore_uploads"

    def schema(self) -> str:
        return "path string, length long, changed_ms long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _UploadReader(self.options)


def stream_uploads(spark: SparkSession, folder: str, settle_seconds: float = 0) -> DataFrame:
    """Each upload right below ``folder`` (a path or pattern of folders) once it is there: ``path, project_id, length, changed_ms``.

    An upload is given ``settle_seconds`` after its last change, so that files
    that are still being written wait; clocks of the store and of this machine
    must not differ by more. Folders are looked up when the stream is defined.
    """
    spark.dataSource.register(UploadSource)
    reader = spark.readStream.format(UploadSource.name())
    found = reader.option("homes", json.dumps(upload_homes(spark, folder))).option("settle_ms", int(settle_seconds * 1000)).load()
    # The pattern names folders, so an upload lies one level below what it matches.
    below = project_of(F.col("path"), folder)
    return found.select("path", below.alias("project_id"), "length", "changed_ms")
