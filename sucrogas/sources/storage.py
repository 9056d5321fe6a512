"""Folders on whatever file system the session uses, so that driver and executors see the same files."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by its path or address; a path without a scheme is one of the session's default file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def child(self, name: str) -> str:
        """The address of something in the folder."""
        return f"{self.path}/{name}"

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.child(name))

    def exists(self) -> bool:
        """Whether the folder is there."""
        return self._fs.exists(self._path)

    def names(self) -> list[str]:
        """Names of what is in the folder."""
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path))

    def rename(self, path: str) -> None:
        """Moves the folder; an error if that fails (an existing target)."""
        to = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if self._fs.exists(to) or not self._fs.rename(self._path, to):
            raise FileExistsError(path)

    def delete(self) -> None:
        """Removes the folder with what is in it, if it is there."""
        self._fs.delete(self._path, True)

    def write_text(self, name: str, text: str) -> None:
        """Writes a small text."""
        out = self._fs.create(self._at(name), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read_text(self, name: str) -> str:
        """Reads a small text."""
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()
