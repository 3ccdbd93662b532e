"""A keyed table as a base, a log of changes and a pointer, for a queue that many small rounds change.

Each commit writes only the rows that it changes to a folder of its own and then publishes the next version: a small file that names the base and
the change folders. Publishing is a rename that fails if that version is there, so of two writers that read the same version one
is refused, and a reader sees a whole version or the one before. Reading merges the log: the latest change of a key counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has published the version this commit was to be."""


@dataclass(frozen=True)
class Version:
    number: int
    base: str
    changes: list[str] = field(default_factory=list)  # oldest first
    applied: dict[str, int] = field(default_factory=dict)  # the last batch of each writer


class VersionedTable:
    """Table of ``schema`` whose rows are told apart by ``key``, in the folder ``path`` that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: Sequence[str] = ("id",)):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, list(key)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), spark._jsc.hadoopConfiguration())
        self._create = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
        self._options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
        self._options[0] = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
        self._keep_existing = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._keep_existing[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE

    # --- the pointer ---

    def _file(self, number: int):
        return self._path(f"{self.path}/versions/{number:010d}.json")

    def _there(self, number: int) -> bool:
        return self._files.util().exists(self._file(number))

    def version(self, number: int | None = None) -> Version:
        """The version of this number, else the newest. Versions are probed in steps that double, then by halves."""
        if number is None:
            if not self._there(0):
                raise FileNotFoundError(self.path)
            low, step = 0, 1
            while self._there(low + step):
                low, step = low + step, step * 2
            high = low + step
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if self._there(middle) else (low, middle)
            number = low
        stream = self._files.open(self._file(number))
        try:
            told = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(told))

    def _publish(self, version: Version) -> Version:
        written = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = self._files.create(written, self._create, self._options)
        try:
            stream.write(bytearray(json.dumps(asdict(version)).encode()))
        finally:
            stream.close()
        try:
            self._files.rename(written, self._file(version.number), self._keep_existing)
        except Py4JJavaError as error:
            self._files.delete(written, False)
            if self._there(version.number):
                raise Conflict(f"version {version.number} of {self.path} is there") from error
            raise
        return version

    # --- rows ---

    def _stored(self, rows: DataFrame, label: str) -> str:
        folder = f"{label}-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.path}/{folder}")
        return folder

    def create(self, rows: DataFrame) -> Version:
        return self._publish(Version(0, self._stored(rows, "base")))

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of a version. The log is grouped by key on the map side; the base is joined with what is left of it."""
        version = version or self.version()
        reader = self.spark.read.schema(self.schema)
        base = reader.parquet(f"{self.path}/{version.base}")
        if not version.changes:
            return base
        logged = None
        for number, folder in enumerate(version.changes):
            part = reader.parquet(f"{self.path}/{folder}").withColumn("_number", F.lit(number))
            logged = part if logged is None else logged.unionByName(part)
        newest = logged.groupBy(*self.key).agg(F.max_by(F.struct(*self.schema.names), "_number").alias("_row")).select("_row.*")
        return base.join(newest, self.key, "left_anti").unionByName(newest.select(*self.schema.names))

    def changes(self, version: Version) -> DataFrame:
        """What the last commit of a version changed."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version.changes[-1]}")

    def commit(self, changed: DataFrame, read: Version, writer: str | None = None, batch: int = 0) -> Version:
        """Publish the new or changed rows of a writer that has read version ``read``; one row a key.

        Raises Conflict if another version has been published since. With ``writer`` a batch that this writer has
        published before is a replay: nothing is written and the newest version returned.
        """
        newest = self.version()
        if writer is not None and newest.applied.get(writer, -1) >= batch:
            return newest
        if newest.number != read.number:
            raise Conflict(f"version {read.number} of {self.path} was read, {newest.number} is there")
        applied = read.applied | ({writer: batch} if writer is not None else {})
        return self._publish(Version(read.number + 1, read.base, [*read.changes, self._stored(changed, "changes")], applied))

    def compact(self, read: Version | None = None) -> Version:
        """Publish the merged rows as the base of a next version with an empty log; Conflict if another came first."""
        read = read or self.version()
        if not read.changes:
            return read
        return self._publish(Version(read.number + 1, self._stored(self.read(read), "base"), [], read.applied))
