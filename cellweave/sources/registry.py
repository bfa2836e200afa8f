"""Results kept beside the data: named, versioned tables that any session can read back.

``save`` writes a result as Parquet under a name of its own and then puts one small
manifest file in place, in one step that fails if another writer has taken the
version; it then takes the next. So a version is whole or not there, writers never
overwrite each other, and old versions stay readable. A folder without a manifest is what a
writer left that never committed.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.-]*")


class ResultRegistry:
    """Results under ``path``, a folder (URI) that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def names(self) -> list[str]:
        """Names that have a version, in order."""
        if not self._fs.exists(self._at()):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._at()) if s.isDirectory()]
        return sorted(n for n in found if self.versions(n))

    def versions(self, name: str) -> list[int]:
        """Committed versions of a name, ascending."""
        folder = self._at(_checked(name), "versions")
        if not self._fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in found if re.fullmatch(r"\d+\.json", n))

    def save(self, df: DataFrame, name: str, note: str = "") -> int:
        """Write a result and commit it; the version that it got."""
        data = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{_checked(name)}/{data}")
        manifest = json.dumps({"data": data, "schema": json.loads(df.schema.json()), "note": note})
        version = (self.versions(name) or [0])[-1] + 1
        while not self._claim(name, version, manifest):
            version += 1
        return version

    def manifest(self, name: str, version: int | None = None) -> dict:
        """Manifest of a version (the last where none is given): folder of the data, schema and note."""
        found = self.versions(name)
        version = version if version is not None else (found or [0])[-1]
        if version not in found:
            raise KeyError(f"{name} has no version {version}" if found else f"nothing is kept as {name}")
        stream = self._fs.open(self._at(name, "versions", f"{version:09d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A version of a result, the last where none is given."""
        from pyspark.sql.types import StructType

        kept = self.manifest(name, version)
        return self.spark.read.schema(StructType.fromJson(kept["schema"])).parquet(f"{self.path}/{name}/{kept['data']}")

    def _claim(self, name: str, version: int, text: str) -> bool:
        """Put a whole manifest in place unless one is there."""
        folder = self._at(name, "versions")
        self._fs.mkdirs(folder)
        draft, target = self._at(name, f"draft-{uuid.uuid4().hex}"), self._at(name, "versions", f"{version:09d}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        if self._fs.getScheme() == "file":  # Hadoop's local rename replaces what is there; a link does not
            here = lambda p: unquote(urlparse(p.toUri().toString()).path)
            try:
                os.link(here(draft), here(target))
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(draft, False)
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(draft, target, options)
            return True
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise


def _checked(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no name for a result: letters, digits, '_', '-' and '.' only")
    return name
