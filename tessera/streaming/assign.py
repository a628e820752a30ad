"""Clustering of molecules as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.fingerprints import featurize
from tessera.operators.pqkmeans import PQKMeansModel
from tessera.sources.text import pick_token


def assigned(smiles: DataFrame, model: PQKMeansModel, kind: str = "mqn", **params) -> DataFrame:
    """(smiles, cluster_id) of a table or a stream of SMILES; no state, so nothing is shuffled."""
    fps = featurize(smiles, kind, **params)
    return model.assign(model.pq.encode(fps)).select("smiles", F.col("cluster_id").cast("int"))


def stream_assign(spark: SparkSession, source: str, model: PQKMeansModel, out: str, checkpoint: str, col: int = 0, kind: str = "mqn", files_per_trigger: int = 64, continuous: bool = False, **params) -> StreamingQuery:
    """Reads new text files of a folder and appends Parquet.  The checkpoint remembers files that are done,
    so a rerun adds only what is new; without ``continuous`` it ends when all present files are done."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(source)
    writer = assigned(pick_token(lines, col), model, kind, **params).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer if continuous else writer.trigger(availableNow=True)).start()
