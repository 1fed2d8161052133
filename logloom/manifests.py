"""Numbered JSON files of which the newest one counts: how stored state changes as a whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class ConflictError(RuntimeError):
    """Another writer committed first; read again and retry."""


class Manifests:
    """The manifests ``1.json, 2.json, ...`` of a folder that driver and executors share.

    A manifest is written under a hidden name and then takes its number, which fails if the number is taken:
    by a hard link on a mounted folder, by the rename that never replaces on HDFS. Object stores show a file only
    when it is whole, so there it is created under its number, without overwriting. Of two writers the later fails.
    """

    def __init__(self, spark: SparkSession, folder: str, sync: bool = False):
        """``sync``: whether a manifest must be on disk before it counts, not only with the file system."""
        self.spark, self.folder, self.sync = spark, folder.rstrip("/"), sync
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path(self.folder).getFileSystem(self._conf)

    def times(self) -> dict[int, int]:
        """The number of each manifest, and when it was written, in milliseconds."""
        at = self._path(self.folder)
        if not self.fs.exists(at):
            return {}
        found = {}
        for s in self.fs.listStatus(at):
            stem, dot, end = s.getPath().getName().partition(".")
            if stem.isdigit() and dot and end == "json":
                found[int(stem)] = s.getModificationTime()
        return found

    def read(self, number: int) -> dict:
        stream = self.fs.open(self._path(f"{self.folder}/{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict | None]:
        """The number and the body of the newest manifest; 0 and None if there is none."""
        number = max(self.times(), default=0)
        return number, self.read(number) if number else None

    def commit(self, body: dict, after: int) -> int:
        """Writes the manifest that follows number ``after`` and returns its number."""
        final = self._path(f"{self.folder}/{after + 1}.json")
        data = bytearray(json.dumps(body).encode())
        kind = self.fs.getUri().getScheme()
        try:
            if kind not in ("file", "hdfs", "viewfs"):
                self._write(final, data)
                return after + 1
            hidden = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
            self._write(hidden, data)
            try:
                self._rename(hidden, final, kind)
            finally:
                self.fs.delete(hidden, False)
        except Exception as e:
            if after + 1 in self.times():
                raise ConflictError(f"manifest {after + 1} of {self.folder} is there already") from e
            raise
        return after + 1

    def _write(self, path, data: bytearray) -> None:
        stream = self.fs.create(path, False)
        try:
            stream.write(data)
            if self.sync:
                stream.hsync()
        finally:
            stream.close()

    def _rename(self, hidden, final, kind: str) -> None:
        jvm = self.spark._jvm
        if kind == "file":
            local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, hidden)]
            jvm.java.nio.file.Files.createLink(*local)
            return
        how = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(how, 1)
        options[0] = how.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(hidden, final, options)
