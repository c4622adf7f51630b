"""Keyed tables that streams keep up to date: the state of a running total as Parquet.

A table holds one row per key in buckets of the key's hash. Each micro-batch
rewrites only the buckets it touches, as a version of its own, and then names
the version of every bucket in a manifest, which is put in place by one rename.
A batch that is run again starts from the manifest before it and gives the same
version. Readers see whole versions. Versions that no manifest names any more
are removed, one batch late, so a reader that has begun can finish.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 32


class KeyedTable:
    """Rows of ``schema`` by ``keys``.

    ``merge`` says for each other column how the values of a key become one, such
    as ``{"n": F.sum}``; it is used on a micro-batch and again on old and new rows.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, keys: list[str],
        merge: dict[str, Callable[[str], Column]], buckets: int = BUCKETS,
    ):
        self.spark, self.path, self.schema, self.keys, self.merge, self.buckets = spark, path.rstrip("/"), schema, keys, merge, buckets

    def _file_system(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _manifests(self) -> list[int]:
        system, folder = self._file_system(f"{self.path}/manifests")
        if not system.exists(folder):
            return []
        names = (f.getPath().getName() for f in system.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, number: int | None) -> dict[int, int]:
        """Version of every bucket."""
        if number is None:
            return {}
        system, path = self._file_system(f"{self.path}/manifests/{number}.json")
        stream = system.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def _write_manifest(self, number: int, versions: dict[int, int]) -> None:
        system, begun = self._file_system(f"{self.path}/manifests/_{number}")
        out = system.create(begun, True)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        _, done = self._file_system(f"{self.path}/manifests/{number}.json")
        system.delete(done, False)
        system.rename(begun, done)

    def _rows(self, versions: dict[int, int], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/version={v}/bucket={b}" for b, v in sorted(versions.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows of the last whole version."""
        numbers = self._manifests()
        return self._rows(self._manifest(numbers[-1] if numbers else None))

    def before(self, batch_id: int) -> tuple[dict[int, int], DataFrame]:
        """Versions and rows as they were before a batch."""
        numbers = [n for n in self._manifests() if n < batch_id]
        versions = self._manifest(numbers[-1] if numbers else None)
        return versions, self._rows(versions)

    def upsert(self, rows: DataFrame, batch_id: int, keep: Column | None = None) -> None:
        """Merge a micro-batch into the table; ``keep`` drops rows of the touched buckets that have outlived their use."""
        names = [f.name for f in self.schema.fields]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        versions, _ = self.before(batch_id)
        rows = rows.select(*names).groupBy(*self.keys).agg(*[f(c).alias(c) for c, f in self.merge.items()])
        # At most as many numbers as there are buckets.
        touched = {r[0] for r in rows.select(bucket).distinct().collect()}
        if touched:
            both = self._rows(versions, touched).unionByName(rows)
            merged = both.groupBy(*self.keys).agg(*[f(c).alias(c) for c, f in self.merge.items()])
            if keep is not None:
                merged = merged.filter(keep)
            typed = merged.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], bucket.alias("bucket"))
            typed.repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={batch_id}")
            versions = {b: v for b, v in versions.items() if b not in touched} | {b: batch_id for b in self._written(batch_id)}
        self._write_manifest(batch_id, versions)
        self._clean(batch_id)

    def _written(self, version: int) -> list[int]:
        system, folder = self._file_system(f"{self.path}/version={version}")
        names = (f.getPath().getName() for f in system.listStatus(folder))
        return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]

    def _clean(self, batch_id: int) -> None:
        """Remove versions and manifests that only manifests before the last two name."""
        numbers = [n for n in self._manifests() if n <= batch_id]
        kept, old = numbers[-2:], numbers[:-2]
        if not old:
            return
        used = {(b, v) for n in kept for b, v in self._manifest(n).items()}
        for number in old:
            for b, v in self._manifest(number).items():
                if (b, v) not in used:
                    system, path = self._file_system(f"{self.path}/version={v}/bucket={b}")
                    system.delete(path, True)
            system, path = self._file_system(f"{self.path}/manifests/{number}.json")
            system.delete(path, False)
