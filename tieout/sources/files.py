"""Small control files in any store that Spark reads: written whole, never over one another.

``put`` makes a file with all its content visible in one step and refuses if the name
is taken, so of two writers one loses.  A ``Versioned`` file is a row of such files;
writing the next version is a compare-and-swap against the one that was read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from tieout.errors import Conflict


class Files:
    """Hadoop's FileSystem, as far as control files need it."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self.at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        p, fs = self.at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        p, fs = self.at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def age_ms(self, path: str) -> int:
        p, fs = self.at(path)
        return self.jvm.java.lang.System.currentTimeMillis() - fs.getFileStatus(p).getModificationTime()

    def read(self, path: str) -> str:
        p, fs = self.at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """Writes a new file; raises ``Conflict`` if there is one of that name."""
        target, draft, fs = self._drafted(path, text)
        try:
            if fs.getScheme() == "file":  # a link refuses a taken name, which a local rename does not
                self.jvm.java.nio.file.Files.createLink(*(self.jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft)))
            else:
                self._renamed(fs, draft, target)
        except Exception as e:
            if not fs.exists(target):
                raise
            raise Conflict(f"{path} is there already") from e
        finally:
            fs.delete(draft, False)

    def replace(self, path: str, text: str) -> None:
        """Writes a file over another one, if there is one."""
        target, draft, fs = self._drafted(path, text)
        self._renamed(fs, draft, target, "OVERWRITE")

    def _drafted(self, path: str, text: str):
        target, fs = self.at(path)
        fs.mkdirs(target.getParent())
        draft, _ = self.at(f"{target.getParent().toString()}/.{uuid.uuid4().hex}.draft")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return fs.makeQualified(target), fs.makeQualified(draft), fs

    def _renamed(self, fs, draft, target, *options: str) -> None:
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        given = self.gateway.new_array(kind, len(options))
        for i, name in enumerate(options):
            given[i] = getattr(kind, name)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(draft, target, given)


class Versioned:
    """A JSON value kept as numbered files in one folder; the highest number is the value."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.files, self.folder = Files(spark), folder.rstrip("/")

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return max((int(n.split(".")[0]) for n in self.files.names(self.folder) if n.endswith(".json")), default=0)

    def read(self, version: int | None = None):
        """(version, value) of one version, by default the newest; (0, None) before the first."""
        version = self.version() if version is None else version
        return (version, json.loads(self.files.read(self._path(version)))) if version else (0, None)

    def swap(self, version: int, value) -> int:
        """Writes what follows ``version``; raises ``Conflict`` if something else has."""
        self.files.put(self._path(version + 1), json.dumps(value, separators=(",", ":"), default=str))
        return version + 1

    def forget(self, keep: int) -> None:
        """Deletes all versions but the newest ``keep``."""
        newest = self.version()
        for n in self.files.names(self.folder):
            if n.endswith(".json") and int(n.split(".")[0]) <= newest - keep:
                self.files.delete(f"{self.folder}/{n}")

    def _path(self, version: int) -> str:
        return f"{self.folder}/{version:012d}.json"
