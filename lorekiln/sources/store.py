"""Versioned snapshots of the index tables.

A publication writes its rows into a folder of its own and then claims the next version number by creating that
version's marker, which names the folder of its manifest. Of two writers only one can claim a number, and neither
touches what the other wrote; a lost writer leaves nothing but an unnamed folder.

Tables that hang on files are kept in segments: a publication adds the rows of the files it changed, and a row counts
as long as ``files`` names its segment for its file. The other tables are written whole.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from lorekiln.schemas import SEGMENTED, TABLES

#: Segments of a table from which a publication writes them together.
MOST_SEGMENTS = 32


class Store:
    """The versions below one directory, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        at = self._path(f"{self.root}/versions")
        if not self._fs.exists(at):
            return []
        # a marker that is not written to the end is none yet
        return sorted(int(m[1]) for s in self._fs.listStatus(at) if (m := re.fullmatch(r"v(\d+)", s.getPath().getName())) and s.getLen() == 32)

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        # without overwriting: of two writers of one path the second fails
        stream = self._fs.create(self._path(path), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of each table in a version, by default the last; empty if there is none."""
        known = self.versions()
        if not known:
            return {}
        return json.loads(self._text(f"{self.root}/data/{self._text(f'{self.root}/versions/v{version or known[-1]:08d}')}/manifest.json"))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of a version, by default the last; empty if there is none."""
        return self._current(table, self.manifest(version)).drop("segment", *([] if "file_id" in TABLES[table] else ["file_id"]))

    def _current(self, table: str, manifest: dict[str, list[str]]) -> DataFrame:
        schema = TABLES[table] + ("" if table not in SEGMENTED else ", segment string" if "file_id" in TABLES[table] else ", file_id string, segment string")
        if not manifest.get(table):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{folder}/{table}" for folder in manifest[table]])
        if table not in SEGMENTED or table == "files":
            return rows
        files = self.spark.read.schema(TABLES["files"] + ", segment string").parquet(*[f"{self.root}/data/{folder}/files" for folder in manifest["files"]])
        return rows.join(files.select("file_id", "segment"), ["file_id", "segment"], "left_semi").select(*rows.columns)

    def publish(self, whole: dict[str, DataFrame], added: dict[str, DataFrame], base: int | None = None) -> int:
        """Writes ``whole`` tables and adds ``added`` rows to segmented ones as a new version on top of ``base``.

        ``base`` is the version that the rows were made from, by default the last. Raises FileExistsError if another
        writer has published on it before.
        """
        base = base if base is not None else (self.versions() or [0])[-1]
        before = self.manifest(base) if base else {}
        folder = uuid.uuid4().hex
        manifest = dict(before)
        for name, rows in whole.items():
            rows.write.parquet(f"{self.root}/data/{folder}/{name}")
            manifest[name] = [folder]
        for name, rows in added.items():
            old = before.get(name, [])
            if len(old) >= MOST_SEGMENTS:
                rows, old = rows.unionByName(self._current(name, before | {"files": manifest["files"]})), []
            rows.write.parquet(f"{self.root}/data/{folder}/{name}")
            manifest[name] = [*old, folder]
        self._write(f"{self.root}/data/{folder}/manifest.json", json.dumps(manifest))
        try:
            self._write(f"{self.root}/versions/v{base + 1:08d}", folder)
        except Exception as error:
            raise FileExistsError(f"version {base + 1} was published by another writer") from error
        return base + 1

