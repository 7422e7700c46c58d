"""Files in the store that Spark writes to, through Hadoop's file systems: local, HDFS or object stores alike."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _fs(self, p):
        return p.getFileSystem(self._conf)

    def exists(self, name: str = "") -> bool:
        p = self.path(name)
        return self._fs(p).exists(p)

    def names(self, name: str = "") -> list[str]:
        p = self.path(name)
        return sorted(s.getPath().getName() for s in self._fs(p).listStatus(p)) if self._fs(p).exists(p) else []

    def read(self, name: str) -> str:
        p = self.path(name)
        stream = self._fs(p).open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside the file, then rename over it, so that readers see the old or the new text."""
        new, p = self.path(f"{name}.new"), self.path(name)
        out = self._fs(new).create(new, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self._jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        array[0] = options.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else self._fs(p).getUri(), self._conf).rename(self._fs(new).makeQualified(new), self._fs(p).makeQualified(p), array)

    def delete(self, name: str = "") -> None:
        p = self.path(name)
        self._fs(p).delete(p, True)

    def size(self, name: str = "") -> int:
        p = self.path(name)
        return int(self._fs(p).getContentSummary(p).getLength()) if self._fs(p).exists(p) else 0
