"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one of this machine, if the session runs on this machine
    alone; on a cluster that is an error, since executors elsewhere couldn't read it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="quillstone-"))
    return sc.getCheckpointDir()


#: The tables written inside scope(), by the thread that entered it.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession):
    """Inside, tables that this thread writes are known; the function that it gives deletes them but for the last `keep`, and returns how many.
    Only for when no DataFrame that is still wanted reads them."""
    written: list[str] = []
    token = _scope.set(written)

    def clean(keep: int = 0) -> int:
        gone, written[:] = written[: len(written) - keep], written[len(written) - keep :]
        jvm = spark.sparkContext._jvm
        for path in gone:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return len(gone)

    try:
        yield clean
    finally:
        _scope.reset(token)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (written := _scope.get()) is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
