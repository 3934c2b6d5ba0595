"""Small files on whatever file system Spark reads: listed, written whole or not at all, renamed, removed.

For the driver's own bookkeeping (logs, metrics, pointers); data goes through Spark's readers and writers.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """What lies in the folder, in order; nothing if it is not there."""
        at = self._at(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file has its name once it is whole."""
        working = self._at(f"{name}.working")
        stream = self.fs.create(working, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.delete(self._at(name), False)
        if not self.fs.rename(working, self._at(name)):
            raise OSError(f"{self.path}/{name} could not be written")

    def rename(self, name: str, to: str) -> None:
        self.fs.mkdirs(self._at(to).getParent())
        if not self.fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{self.path}/{name} could not be renamed to {to}")

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)
