"""The folder that driver and executors share, for what the engine itself writes."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; a session on one machine may go without and gets a folder of its own."""
    context = spark.sparkContext
    if named := spark.conf.get(SETTING, None) or context.getConf().get(SETTING, None):
        return named.rstrip("/")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError(f"{SETTING} names no shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spreadlake"))
    return context._jsc.sc().getCheckpointDir().get()


class Files:
    """Small files and folders through the file system that a path names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.fs = self.path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Fails if the file is there: of two writers of a version one must begin anew."""
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
