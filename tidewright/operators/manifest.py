"""Versioned manifests: the atomic switch behind the persistent tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession


class Manifest:
    """A JSON state kept as numbered files under ``root/_manifest``; the highest number is current.

    A commit writes a temporary file and gives it the next number, which fails where that number is taken, so of two writers one loses and must redo
    its work against the newer state; readers see either the old or the new state, never a mixture. On a local file system that is a hard link; on
    others a rename, which the file system must do atomically and refuse where the name exists, as HDFS does. Object stores do neither: there only one
    writer at a time may commit.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._dir = f"{self.root}/_manifest"

    def _numbers(self) -> list[int]:
        d = self._path(self._dir)
        if not self._fs.exists(d):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(d))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self) -> tuple[int, dict]:
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        stream = self._fs.open(self._path(f"{self._dir}/{numbers[-1]:010d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return numbers[-1], json.loads(text)

    def commit(self, version: int, state: dict) -> int:
        """Makes `state` the successor of `version`."""
        tmp = self._path(f"{self._dir}/.{version + 1:010d}.tmp")
        out = self._fs.create(tmp, True)
        try:
            out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            out.close()
        name = f"{self._dir}/{version + 1:010d}.json"
        if not self._take(tmp, self._path(name)):
            raise RuntimeError(f"version {version + 1} of {self.root} was committed by another writer")
        return version + 1

    def _take(self, tmp, final) -> bool:
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(tmp.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                self._fs.delete(tmp, False)
            return True
        return not self._fs.exists(final) and self._fs.rename(tmp, final)

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the last `keep` states."""
        for n in self._numbers()[:-keep]:
            self._fs.delete(self._path(f"{self._dir}/{n:010d}.json"), False)
