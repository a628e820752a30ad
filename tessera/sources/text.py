"""Line-oriented molecule files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.paths import expand_paths

#: White space as Python's split() sees it, Unicode included.
SPACES = "(?U)\\s+"


def pick_token(lines: DataFrame, col: int = 0, line_col: str = "value") -> DataFrame:
    """(smiles): the col-th token by white space; lines without one are dropped, commas are data."""
    tokens = F.split(F.regexp_replace(F.col(line_col), "(?U)^\\s+|\\s+$", ""), SPACES)
    token = F.try_element_at(tokens, F.lit(col + 1))
    rest = [c for c in lines.columns if c != line_col]
    return lines.select(*rest, token.alias("smiles")).where(F.col("smiles").isNotNull() & (F.col("smiles") != ""))


def scan_text(spark: SparkSession, source: str | Iterable[str], col: int = 0) -> DataFrame:
    """(smiles) of text files, or of .sdf and .sd files; a missing source fails at once."""
    files = expand_paths(spark, source)
    mol = [f for f in files if f.lower().endswith((".sdf", ".sd"))]
    plain = [f for f in files if f not in set(mol)]
    parts = ([pick_token(spark.read.text(plain), col)] if plain else []) + ([scan_sdf(spark, mol)] if mol else [])
    if not parts:
        return spark.createDataFrame([], "smiles string")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def scan_sdf(spark: SparkSession, files: list[str]) -> DataFrame:
    """(smiles) of the records of SD files; records that can't be read are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tessera.functions.smiles import from_molblock, to_smiles

        for batch in batches:
            out = []
            for record in batch["value"]:
                mol = from_molblock(record)
                if mol is not None:
                    out.append(to_smiles(mol))
            yield pd.DataFrame({"smiles": out}, dtype=object)

    return spark.read.option("lineSep", "$$$$").text(files).mapInPandas(run, "smiles string")


#: Positions of a file that are numbered in one group.
NUMBERED = 1 << 16


def chunk_ids(rows: DataFrame, size: int | None, file_col: str, order_col: str) -> DataFrame:
    """Adds ``chunk``: rows of a file in order, ``size`` to a chunk; a chunk never spans files.  None: one per file.

    ``order_col`` has positions, whole numbers.  A long file is numbered in groups of NUMBERED positions,
    each after the rows of the groups before it, so it is not one task.
    """
    if size is None:
        return rows.withColumn("chunk", F.lit(0).cast("long"))
    dealt = rows.withColumn("_group", F.floor(F.col(order_col) / NUMBERED))
    held = dealt.groupBy(file_col, "_group").agg(F.count("*").alias("_held"))
    earlier = Window.partitionBy(file_col).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(file_col, "_group", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(file_col, "_group").orderBy(order_col))
    out = dealt.join(before, [file_col, "_group"]).withColumn("chunk", F.floor((F.col("_before") + nth - 1) / size).cast("long"))
    return out.select(*rows.columns, "chunk")


def train_head(rows: DataFrame, n: int, order_col: str) -> DataFrame:
    """The first n rows, for training."""
    return rows.orderBy(order_col).limit(n)


def share_drawn(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """About n rows, drawn by a threshold on a seeded hash: a filter, so nothing is sorted and the partitions stay."""
    many = rows.count()
    if many <= n:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * n / many))


def subsample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, the same for a seed however the rows are partitioned, in order of the key."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n).orderBy(key)
