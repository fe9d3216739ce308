"""File operations through Hadoop's file systems, so a database can lie wherever Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        p, fs = self._path(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        p, fs = self._path(old)
        if not fs.rename(p, self._path(new)[0]):
            raise OSError(f"cannot rename {old} to {new}")

    def copy(self, old: str, new: str) -> None:
        (p, a), (q, b) = self._path(old), self._path(new)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, self._conf)

    def list(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def has_text(self, path: str) -> bool:
        return self.exists(path) or self.exists(f"{path}.new")

    def read_text(self, path: str) -> str:
        """Content that `write_text` left; if it was stopped before its last step, the new one."""
        p, fs = self._path(path if self.exists(path) else f"{path}.new")
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """The old content stays until the new one is complete, and readers find the new one from then on."""
        p, fs = self._path(f"{path}.new")
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs.delete(self._path(path)[0], False)
        self.rename(f"{path}.new", path)
