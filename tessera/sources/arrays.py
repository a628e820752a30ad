"""Arrays in .npy and .npz files, wide code tables, and chunk files."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.paths import expand_paths, write_bytes


def scan_npy(spark: SparkSession, source: str | list[str], limit: int | None = None, npz_key: str | None = None, name: str = "fp") -> DataFrame:
    """(file, row, fp) of the rows of 2-D arrays, files in order of their names; ``limit`` takes the first rows."""
    files = [f for f in expand_paths(spark, source) if f.endswith((".npy", ".npz"))]
    if not files:
        raise FileNotFoundError(f"no .npy or .npz files in {source}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                held = np.load(io.BytesIO(content), allow_pickle=False)
                x = held if isinstance(held, np.ndarray) else held[npz_key or held.files[0]]
                if x.ndim != 2:
                    raise ValueError(f"{path}: a 2-D array is needed, not {x.ndim}-D")
                for a in range(0, len(x), 4096):
                    yield pd.DataFrame({"file": path, "row": np.arange(a, min(a + 4096, len(x))), "fp": list(x[a:a + 4096].astype(float))})

    rows = spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(run, "file string, row long, fp array<double>")
    rows = rows.withColumnRenamed("fp", name)
    return rows if limit is None else rows.orderBy("file", "row").limit(limit)


def code_columns(columns: list[str], prefixes: tuple[str, ...] = ("pq_code_", "pq_", "fp_")) -> list[str]:
    """Wide columns of the first prefix that occurs, by the number that ends them."""
    for prefix in prefixes:
        found = [(int(m[1]), c) for c in columns if (m := re.fullmatch(re.escape(prefix) + r"(\d+)", c))]
        if found:
            return [c for _, c in sorted(found)]
    raise ValueError(f"no columns with a prefix of {', '.join(prefixes)}")


def to_array(df: DataFrame, columns: list[str] | None = None, name: str = "codes", prefixes: tuple[str, ...] = ("pq_code_", "pq_", "fp_")) -> DataFrame:
    """Wide columns become one array column."""
    if columns and (lost := [c for c in columns if c not in df.columns]):
        raise ValueError(f"missing columns: {', '.join(lost)}")
    wide = columns or code_columns(df.columns, prefixes)
    return df.select(*[F.col(c) for c in df.columns if c not in set(wide)], F.array(*wide).alias(name))


def to_wide(df: DataFrame, name: str, width: int, prefix: str) -> DataFrame:
    """An array column becomes ``width`` columns."""
    return df.select(*[F.col(c) for c in df.columns if c != name], *[F.col(name)[k].alias(f"{prefix}{k}") for k in range(width)])


def scan_codes(spark: SparkSession, source: str | list[str], columns: list[str] | None = None, delimiter: str = ",", npz_key: str | None = None) -> DataFrame:
    """(codes, ...) of .npy, .npz, .csv and Parquet inputs."""
    files = expand_paths(spark, source)
    parts = []
    if arrays := [f for f in files if f.endswith((".npy", ".npz"))]:
        parts.append(scan_npy(spark, arrays, npz_key=npz_key, name="codes").select(F.col("codes").cast("array<int>")))
    if csv := [f for f in files if f.endswith(".csv")]:
        parts.append(to_array(spark.read.csv(csv, header=True, inferSchema=True, sep=delimiter), columns))
    if parquet := [f for f in files if f.endswith(".parquet")]:
        parts.append(to_array(spark.read.option("mergeSchema", "true").parquet(*parquet), columns))
    if not parts:
        raise ValueError(f"no code files in {source}")
    out = parts[0].withColumn("codes", F.col("codes").cast("array<int>"))
    for more in parts[1:]:
        out = out.unionByName(more.withColumn("codes", F.col("codes").cast("array<int>")), allowMissingColumns=True)
    return out


def gen_codes(spark: SparkSession, n: int, m: int, k: int = 256, seed: int = 0) -> DataFrame:
    """(id, codes): uniform codes, for trials without an input."""
    return spark.range(n).select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(seed), F.lit(s)), F.lit(k)).cast("int") for s in range(m)]).alias("codes"))


def save_chunk(chunk: np.ndarray | pd.DataFrame, folder: str, index: int, file_format: str = "npy", name: str = "chunk", spark: SparkSession | None = None) -> str:
    """Writes one chunk that the driver holds as ``{name}_{index:05d}`` and returns the path; with a session, on any file system."""
    out = io.BytesIO()
    if file_format == "npy":
        np.save(out, np.asarray(chunk))
    elif file_format == "parquet":
        wide = chunk if isinstance(chunk, pd.DataFrame) else pd.DataFrame(np.asarray(chunk), columns=[f"fp_{i}" for i in range(np.asarray(chunk).shape[1])])
        wide.to_parquet(out, index=False)
    else:
        raise ValueError(f"format {file_format!r} is not npy or parquet")
    path = f"{folder.rstrip('/')}/{name}_{index:05d}.{file_format}"
    if spark is not None:
        write_bytes(spark, path, out.getvalue())
    else:
        os.makedirs(folder, exist_ok=True)
        with open(path, "wb") as f:
            f.write(out.getvalue())
    return path
