"""Questions to a table of clustered molecules (smiles, cluster_id, ...)."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.paths import _fs, column

#: Ids above which an IN list becomes a join.
IN_LIST = 1000


def query_cluster(rows: DataFrame, cluster_id: int, cluster_column: str = "cluster_id", columns: list[str] | None = None, warn: bool = False) -> DataFrame:
    """The rows of one cluster; none is no error, and with ``warn``, which takes a job, a warning."""
    out = rows.where(column(cluster_column) == cluster_id)
    if warn and out.limit(1).count() == 0:
        warnings.warn(f"cluster {cluster_id} has no rows", stacklevel=2)
    return out.select(*map(column, columns)) if columns else out


def query_clusters_batch(rows: DataFrame, cluster_ids: Iterable[int], columns: list[str] | None = None, cluster_column: str = "cluster_id") -> DataFrame:
    """The rows of several clusters; no ids, no rows."""
    ids = sorted(set(cluster_ids))
    if len(ids) <= IN_LIST:
        out = rows.where(column(cluster_column).isin(ids)) if ids else rows.where(F.lit(False))
    else:
        wanted = rows.sparkSession.createDataFrame([(i,) for i in ids], "wanted_id long")
        out = rows.join(wanted, column(cluster_column) == F.col("wanted_id"), "left_semi")
    return out.select(*map(column, columns)) if columns else out


def cluster_stats(rows: DataFrame, cluster_column: str = "cluster_id") -> DataFrame:
    """(cluster_id, molecule_count) in order of the id."""
    return rows.groupBy(column(cluster_column).alias("cluster_id")).agg(F.count("*").alias("molecule_count")).orderBy("cluster_id")


def cluster_ids(rows: DataFrame, cluster_column: str = "cluster_id") -> DataFrame:
    return rows.select(column(cluster_column).alias("cluster_id")).distinct().orderBy("cluster_id")


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def top_clusters(rows: DataFrame, n: int, cluster_column: str = "cluster_id") -> DataFrame:
    """The n largest clusters; equal ones by id."""
    return cluster_stats(rows, cluster_column).orderBy(F.desc("molecule_count"), "cluster_id").limit(n)


def largest_cluster(rows: DataFrame, cluster_column: str = "cluster_id") -> DataFrame:
    """The rows of the largest cluster."""
    first = top_clusters(rows, 1, cluster_column).select(F.col("cluster_id").alias("largest_id"))
    return rows.join(F.broadcast(first), column(cluster_column) == F.col("largest_id"), "left_semi")


def _drawn(key: str, seed: int | None):
    salt = uuid.uuid4().hex if seed is None else str(seed)
    return F.md5(F.concat_ws("|", F.lit(salt), column(key).cast("string")))


def sample_from_cluster(rows: DataFrame, cluster_id: int, n: int = 100, seed: int | None = None, cluster_column: str = "cluster_id", key: str = "smiles") -> DataFrame:
    """At most n rows of a cluster; with a seed the same ones whatever the partitions are."""
    return query_cluster(rows, cluster_id, cluster_column).orderBy(_drawn(key, seed), column(key)).limit(n)


def representatives(rows: DataFrame, seed: int | None = None, cluster_column: str = "cluster_id", key: str = "smiles") -> DataFrame:
    """(cluster_id, key): one row drawn from each cluster, as a minimum that is combined before the shuffle."""
    best = F.min(F.struct(_drawn(key, seed).alias("h"), column(key).alias("k")))
    return rows.groupBy(column(cluster_column).alias("cluster_id")).agg(best.alias("best")).select("cluster_id", F.col("best.k").alias(key))


def export_cluster(rows: DataFrame, cluster_id: int, path: str, cluster_column: str = "cluster_id", columns: list[str] | None = None) -> int:
    """Writes one cluster to one file by its ending (.parquet, .csv, .smi, .txt) and returns its size; 0 writes none."""
    ending = path.rpartition(".")[2].lower()
    if ending not in ("parquet", "csv", "smi", "txt"):
        raise ValueError(f"a cluster can't be written as .{ending}")
    out = query_cluster(rows, cluster_id, cluster_column, ["smiles"] if ending in ("smi", "txt") else columns)
    n = out.count()
    if not n:
        warnings.warn(f"cluster {cluster_id} has no rows; nothing is written", stacklevel=2)
        return 0
    spark = rows.sparkSession
    fs, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    parts = f"{path}.{uuid.uuid4().hex}"
    one = out.coalesce(1).write
    if ending == "parquet":
        one.parquet(parts)
    elif ending == "csv":
        one.option("header", "true").option("escape", '"').csv(parts)
    else:
        one.text(parts)
    _, folder = _fs(spark, parts)
    part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(folder, True)
    return n


def export_all_clusters(rows: DataFrame, folder: str, file_format: str = "parquet", cluster_column: str = "cluster_id", columns: list[str] | None = None, files_per_cluster: int = 1) -> dict[int, int]:
    """Writes folders ``cluster_id=<id>`` and returns their sizes.  Rows are dealt by cluster first,
    so a task doesn't open a file for each; a few large clusters may want several files."""
    if file_format not in ("parquet", "csv"):
        raise ValueError(f"clusters are written as Parquet or CSV, not {file_format}")
    out = rows.select(*map(column, columns or ["smiles"]), column(cluster_column).alias("cluster_id"))
    if files_per_cluster > 1:
        out = out.repartition("cluster_id", F.pmod(F.xxhash64(*out.columns), F.lit(files_per_cluster)))
    else:
        out = out.repartition("cluster_id")
    out.write.mode("overwrite").partitionBy("cluster_id").format(file_format).option("header", "true").option("escape", '"').save(folder)
    return {r.cluster_id: r.molecule_count for r in cluster_stats(rows, cluster_column).collect()}


def write_sorted(rows: DataFrame, folder: str, cluster_column: str = "cluster_id") -> None:
    """A layout for very many clusters: ranges of ids in order, so row groups outside an id are skipped."""
    rows.repartitionByRange(column(cluster_column)).sortWithinPartitions(column(cluster_column)).write.parquet(folder)


def label_agreement(a: DataFrame, b: DataFrame, key: str, cluster_column: str = "cluster_id") -> DataFrame:
    """(compared, mismatches) of two labelings of the same keys."""
    other = b.select(key, column(cluster_column).alias("other_label"))
    return a.select(key, column(cluster_column).alias("label")).join(other, key).agg(F.count("*").alias("compared"), F.count_if(F.col("label") != F.col("other_label")).alias("mismatches"))
