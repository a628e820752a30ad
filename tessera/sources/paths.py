"""Paths of inputs, checked on the side of Spark's own file systems."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def expand_paths(spark: SparkSession, source: str | Iterable[str]) -> list[str]:
    """Files named by a path, a glob or several; a folder stands for its files, not those of folders in it."""
    if isinstance(source, (list, tuple)):
        return [p for s in source for p in expand_paths(spark, s)]
    if not isinstance(source, str):
        raise TypeError(f"a path or a list of paths is needed, not {type(source).__name__}")
    fs, where = _fs(spark, source)
    found = fs.globStatus(where)
    if found is None or not len(found):
        raise FileNotFoundError(f"no such input: {source}")
    out = []
    for status in found:
        if status.isDirectory():
            out += sorted(s.getPath().toString() for s in fs.listStatus(status.getPath()) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
        else:
            out.append(status.getPath().toString())
    return out


def results(spark: SparkSession, folder: str) -> DataFrame:
    """The Parquet files of a results folder; chunks may lack columns that others have."""
    fs, where = _fs(spark, folder)
    if not fs.exists(where):
        raise FileNotFoundError(f"there is no results folder {folder}")
    if not fs.getFileStatus(where).isDirectory():
        raise ValueError(f"{folder} is a file; results are a folder of chunks")
    if not any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(where)):
        raise ValueError(f"{folder} holds no Parquet file")
    return spark.read.option("mergeSchema", "true").parquet(folder)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def shared_folder(spark: SparkSession) -> str:
    """A new folder that executors share with the driver, gone when the driver ends.

    It is below ``spark.checkpoint.dir``; where that is unset, a local master takes its own disk and any other is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    fs, where = _fs(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file of the driver's, on the path's own file system."""
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(content))
    out.close()


def quoted(name: str) -> str:
    """A column's name in backticks; one that is already quoted stays."""
    return name if len(name) > 1 and name[0] == name[-1] == "`" else "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))
