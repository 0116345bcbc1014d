"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on a single local JVM, where it is unset, a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tidewire-"))
        atexit.register(_clean)
    return "file://" + _OWN[0]


def _clean() -> None:
    import shutil

    shutil.rmtree(_OWN[0], ignore_errors=True)


class Table:
    """A written DataFrame: `df` reads it, `drop()` removes its files once nothing reads it any more."""

    def __init__(self, spark: SparkSession, df: DataFrame, tag: str):
        self._spark, self.path = spark, f"{shared_dir(spark)}/tidewire/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        for made in _WATCHING:
            made.append(self)

    def drop(self) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


_WATCHING: list[list[Table]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[Table]]:
    """Drops, at its end, the tables written inside but those that the caller has taken out of the list."""
    made: list[Table] = []
    _WATCHING.append(made)
    try:
        yield made
    finally:
        _WATCHING.pop()  # contexts end in the reverse order of their beginning
        for table in made:
            table.drop()


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df`, computed once, kept as a Parquet table and read again: lineage ends here."""
    return Table(df.sparkSession, df, tag).df


def kept(df: DataFrame, tag: str, made: list[Table]) -> DataFrame:
    """`df` written inside scratch() and left to those who read it."""
    table = Table(df.sparkSession, df, tag)
    made.remove(table)
    return table.df
