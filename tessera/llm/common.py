"""What the operators of this subpackage share: table access and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that carries whole texts: long texts must not pile up in a worker.
TEXT_BATCH_ROWS = 400
#: Bytes up to which an operator joins such batches where it gains by looking at more texts at once.
GATHERED_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Bounds Arrow batches for the Python operators of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def gathered(batches: Iterator[pa.RecordBatch], limit: int = GATHERED_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches: neighbours are joined up to ``limit`` bytes, and a larger one stays alone."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, with underscores before it until no frame has a column so called, in any case of letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Scratch:
    """A folder that the driver and all executors share, under ``spark.checkpoint.dir``.

    ``write`` stores a DataFrame as Parquet and reads it again, which cuts its lineage by files
    that survive the loss of an executor.  Where the setting is unset, a local master gets a folder of
    its own, as in tests; any other is refused, as its executors would not see the driver's files.
    What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = f"file://{tempfile.gettempdir()}"
        self.root = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
        fs, where = self._at("")
        fs.mkdirs(where)
        fs.deleteOnExit(where)

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        fs, where = self._at(name)
        fs.delete(where, True)

    def only(self, *names: str) -> None:
        """Drops all but these; what still reads the others must have been written."""
        fs, where = self._at("")
        for status in fs.listStatus(where):
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)
