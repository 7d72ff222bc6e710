"""Tables in the folder that all executors share: they cut a lineage and survive lost executors."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of this process where it is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext.getCheckpointDir()
        if not made:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voucherlens-"))
            made = spark.sparkContext.getCheckpointDir()
        found = made
    return found.rstrip("/")


#: Lets Spark delete a query's shuffle files as soon as the query ends, and hands Python workers less at a time than the usual 64 MB.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}
#: For rows of megabytes. Readers hold a row group at once, decompressed and again as it is on disk, and writers look at its size after 100 rows only.
_WIDE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


@contextlib.contextmanager
def in_small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile do so with _WHILE_WRITING."""
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _packs_arrays(df: DataFrame) -> bool:
    """Whether a column holds bytes, as those do where arrays travel instead of rows."""
    return any(isinstance(x.dataType.elementType if isinstance(x.dataType, ArrayType) else x.dataType, BinaryType) for x in df.schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage, survives lost executors, deleted by `discard` or when the session ends.

    Its rows are safe once written, so the shuffle files of the query that made them go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voucherlens/{name}-{uuid.uuid4().hex}"
    with in_small_batches(spark):
        df.write.options(compression="zstd", **(_WIDE_ROWS if _packs_arrays(df) else {})).parquet(path)
    _file_system(spark, path)[0].deleteOnExit(_file_system(spark, path)[1])
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing will read again."""
    for table in tables:
        fs, path = _file_system(table.sparkSession, table._written_path)
        fs.delete(path, True)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target
