"""Small files on any store that Spark can reach."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.base = spark.sparkContext._jvm, base.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def _versions(self, name: str) -> list[str]:
        """The written versions of a small file, the newest first."""
        return sorted((x for x in self.names() if x.startswith(f"{name}.") and x[len(name) + 1 :].isdigit()), reverse=True)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name)) or (self.fs.exists(self._path("")) and bool(self._versions(name)))

    def make(self) -> None:
        self.fs.mkdirs(self._path(""))

    def read(self, name: str) -> str:
        f = self.fs.open(self._path(next(iter(self._versions(name)), name)))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
        finally:
            f.close()

    def write(self, name: str, text: str) -> None:
        """As a new version under a name that no file has yet, so that at any time the newest whole version can be read.

        A crash before the renaming leaves the older version, one after it at most an
        old version that the next write removes.
        """
        old = self._versions(name)
        to = self._path(f"{name}.{int(old[0].rpartition('.')[2]) + 1 if old else 1:012d}")
        temp = self._path(f"_{name}.tmp")
        out = self.fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(temp, to):
            raise OSError(f"{name} could not be written")
        for x in old:
            self.fs.delete(self._path(x), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        path = self._path(name)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one on a single machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: it names the folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quiverline-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")
