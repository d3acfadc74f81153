"""Several tables published as one: readers see all of a version's tables or none.

A publication folder holds ``data/<name>-<id>`` (tables, written before anything refers to them) and ``manifests/<n>``,
one small file per version that names a folder for every table and the batches it contains.  A version appears when its
manifest is renamed to its number, which fails if that is taken: of two writers one wins, the other starts again from the new
version.  A writer that dies leaves tables that no manifest names; repeating a batch that a version contains does
nothing, so a retry is safe at any point.  Manifests hold one line per table and batch, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import sinks

Change = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


class Conflict(RuntimeError):
    """Another writer published this version first."""


class Publication:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version's number, 0 before the first."""
        where = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(where):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "batches": []}
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{version:012d}", wholetext=True).first()["value"])

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(path) for name, path in self.manifest(version)["tables"].items()}

    def _create(self, version: int, content: dict) -> None:
        """The manifest appears whole, under a number that nobody had: renaming it there fails if the number is taken."""
        text = json.dumps(content).encode()
        own = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(own, False)
        out.write(bytearray(text), 0, len(text))
        out.close()
        jvm, rename = self.spark._jvm, getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark._sc._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(own, self._path(f"{self.folder}/manifests/{version:012d}"), how)
        except Exception as error:
            self._fs.delete(own, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {version} is taken") from error
            raise

    def publish(self, change: Change, batch: str, attempts: int = 3) -> int:
        """The version that contains ``batch``: tables that ``change`` makes of the present ones, published together."""
        for attempt in range(attempts):
            now = self.version()
            old = self.manifest(now)
            if batch in old["batches"]:
                return now
            made = change(self.tables(now))
            paths = dict(old["tables"])
            for name, rows in made.items():
                path = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
                rows.write.mode("errorifexists").parquet(path)
                paths[name] = path
            try:
                self._create(now + 1, {"tables": paths, "batches": [*old["batches"], batch]})
            except Conflict:
                if attempt + 1 == attempts:
                    raise
                continue
            return now + 1
        raise Conflict(batch)

    def upsert(self, made: dict[str, DataFrame], keys: dict[str, list[str]], batch: str) -> int:
        """Publishes an upsert of several tables by their keys."""
        return self.publish(lambda stored: {name: sinks.upsert(stored[name], rows, keys[name]) if name in stored else rows for name, rows in made.items()}, batch)

    def retired(self, keep: int = 2) -> list[str]:
        """Table folders that none of the last ``keep`` versions names: left by older versions or by writers that died."""
        newest = self.version()
        held = {p.rsplit("/", 1)[1] for v in range(max(1, newest - keep + 1), newest + 1) for p in self.manifest(v)["tables"].values()}
        data = self._path(f"{self.folder}/data")
        return sorted(s.getPath().toString() for s in self._fs.listStatus(data) if s.getPath().getName() not in held) if self._fs.exists(data) else []

    def vacuum(self, keep: int = 2) -> int:
        """Deletes retired folders; only for times when nobody publishes."""
        doomed = self.retired(keep)
        for path in doomed:
            self._fs.delete(self._path(path), True)
        return len(doomed)
