"""Small files on any file system that Spark reaches, through Hadoop's interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Existence, listing, text and removal below one root path."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)
        # a path without a scheme stays on the file system that the session names
        self.root = self._fs.makeQualified(self._path(root)).toString()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def mkdirs(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        """Names of the entries of a folder, in order; none if there is no folder."""
        if not self.exists(path):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(path)))

    def size(self, path: str) -> int:
        """Bytes below a path."""
        return self._fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def modified(self, path: str) -> float:
        """Seconds since the epoch of the last change."""
        return self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write a new file; a file that exists raises, which is what makes commits exclusive."""
        stream = self._fs.create(self._path(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
