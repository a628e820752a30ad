"""Token ids in ORC files, in ascending order of document id.

Each file holds a contiguous range of documents.  The ids are an array column, which ORC stores
with integer run-length encoding in stripes; each stripe has a row index and Bloom filters on the
document id, so a reader prunes stripes and row groups from metadata, and stripes of a file are
read in parallel.  ``part`` and ``pos`` give a document's place: ids before it in its file, whose
own start is the sum of the files before it (one row per file).

Null and empty texts hold the end id alone.  Null ids come first; rows with one id follow in the
order of their texts' hashes, by which they are dealt too, and repeated rows are all kept.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, gathered, table, text_batches
from tessera.llm.tokens import encoder

#: Bytes of a stripe and rows of a row group, as the writer's options.
STRIPE_BYTES = 16 << 20
ROW_GROUP = 1000


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes the whole texts and writes them below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pos, end = encoder(tokenizer), 0, np.array([end_id], dtype="<u4").tobytes()
        for batch in gathered(batches):
            coded = [x + end for x in encode(batch.column(1).to_pylist())]
            counts = np.array([len(x) // 4 for x in coded], dtype=np.int64)
            stops = np.cumsum(counts)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), type=pa.int32()), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pos + stops - counts), pa.array(counts), ids], names=["doc_id", "pos", "n_tokens", "ids"])
            pos += int(stops[-1]) if len(stops) else 0

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    # the hash parts rows that share an id, null ids too, so that they are not one range
    ranged = docs.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    (
        ranged.mapInArrow(run, "doc_id long, pos long, n_tokens long, ids array<int>")
        .withColumn("part", F.spark_partition_id())
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.row.index.stride", str(ROW_GROUP)).option("orc.create.index", "true")
        .orc(path)
    )


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with ``doc_ids``, only stripes and row groups that may hold them are read."""
    rows = spark.read.schema("doc_id long, pos long, n_tokens long, ids array<int>, part int").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def with_start(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``start``: the ids of all files before, which is one sum per file, and ``pos``.

    There are as many sums as files; they are broadcast only where Spark finds them small.
    """
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = sums.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    return rows.join(before, "part").select(*columns, (F.col("before") + F.col("pos")).alias("start"))


def digests(rows: DataFrame) -> DataFrame:
    """crc32 of each row's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype("<u4")
            stops = np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts.tolist(), stops.tolist())]
            counts = pa.array((stops - starts).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("pos"), counts, pa.array(crc, type=pa.int64())], names=["doc_id", "part", "pos", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    text_batches(spark)
    scratch = Scratch(spark)
    write(table(spark, sf_dir, "documents"), scratch.path("tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    small = scratch.write(digests(read(spark, scratch.path("tokens"))), "digests")
    scratch.drop("tokens")
    return with_start(small, ["doc_id", "n_tokens", "ids_crc32"])
