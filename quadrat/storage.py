"""Tables that cut lineage: written to the folder that driver and executors share, and deleted when nothing reads them."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Held while a table is written: shuffle files go as soon as it is there, and no Arrow batch outgrows a Python worker.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

_made: list[list[DataFrame]] = []  # the tables written in each open settled()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one where that is unset, which only a local session may."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        top = "file://" + os.path.join(tempfile.gettempdir(), "quadrat-checkpoints")
    return top.rstrip("/")


@contextlib.contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, computed once and kept as a Parquet table in the shared folder, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _made:
        _made[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(build: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """The table that build() gives, written if it is not yet; all tables written on the way are deleted."""
    _made.append([])
    try:
        out = build()
        out = out if hasattr(out, "_written_to") else written(out, name)
    finally:
        made = _made.pop()
    discard(*(t for t in made if t is not out))
    if _made:
        _made[-1].append(out)
    return out


def settling(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f with its result settled: for operators of many rounds, whose tables would pile up."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        return settled(lambda: f(*args, **kwargs), f.__name__)

    return run
