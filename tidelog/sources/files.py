"""Small files through the store's own file system, as Spark sees it."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import StoreError


class Folder:
    """A folder by URI; files are written whole and appear by rename."""

    def __init__(self, spark: SparkSession, uri: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(uri)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names: str):
        out = self.path
        for name in names:
            out = self.jvm.org.apache.hadoop.fs.Path(out, name)
        return out

    def uri(self, *names: str) -> str:
        return str(self.fs.makeQualified(self.at(*names)).toString())

    def make(self, *names: str) -> None:
        self.fs.mkdirs(self.at(*names))

    def exists(self, *names: str) -> bool:
        return self.fs.exists(self.at(*names))

    def names(self, *names: str) -> list[str]:
        if not self.exists(*names):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(*names)))

    def size(self, *names: str) -> int:
        return self.fs.getContentSummary(self.at(*names)).getLength()

    def read(self, *names: str) -> bytes:
        stream = self.fs.open(self.at(*names))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_new(self, data: bytes, *names: str) -> None:
        """Write a file that must not exist; readers see all of it or nothing."""
        target, part = self.at(*names), self.at(*names[:-1], f".{names[-1]}.{uuid.uuid4().hex}")
        stream = self.fs.create(part, False)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()
        if not self._take_name(part, target):
            self.fs.delete(part, False)
            raise StoreError(f"{target.toString()} was written by someone else")

    def _take_name(self, part, target) -> bool:
        """Give a written file its name, unless there is one of that name.

        A local file system overwrites on rename, so the name is taken by a link, which one writer
        alone can make. HDFS refuses to rename onto a file. Stores without a rename that refuses
        (plain object stores) need a single writer.
        """
        if self.fs.getScheme() != "file":
            return not self.fs.exists(target) and self.fs.rename(part, target)
        files, paths = self.jvm.java.nio.file.Files, self.jvm.java.nio.file.Paths
        local = lambda path: paths.get(self.fs.makeQualified(path).toUri())
        try:
            files.createLink(local(target), local(part))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        self.fs.delete(part, False)
        return True

    def age_ms(self, *names: str) -> int:
        """Milliseconds since a file or folder was last changed, by this machine's clock."""
        return self.jvm.java.lang.System.currentTimeMillis() - self.fs.getFileStatus(self.at(*names)).getModificationTime()

    def delete(self, *names: str) -> None:
        self.fs.delete(self.at(*names), True)
