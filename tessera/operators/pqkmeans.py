"""k-means over product-quantised codes by symmetric distances."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.base import Estimator, Model
from tessera.operators.pq import PQModel

#: Centers compared at once, and rows: a tile's table of distances stays in the cache.
CENTER_TILE, ROW_TILE = 512, 1024
#: Share by which sums of single-precision tables may be off; what comes this close is compared in double precision.
SLACK = 1e-5


def closest(codes: np.ndarray, centers: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels and distances; tiles over centers with a running minimum, so of equal distances the lowest label.

    Tiles are summed in single precision, which halves the memory traffic; the least of each, and all
    that come within rounding of it, are compared in double precision, so the result is exact.
    """
    label, least = np.zeros(len(codes), dtype=np.int32), np.full(len(codes), np.inf)
    subs, single = np.arange(codes.shape[1]), tables.astype(np.float32)
    for c in range(0, len(centers), CENTER_TILE):
        tile = centers[c:c + CENTER_TILE]
        to_tile = [np.ascontiguousarray(single[s][:, tile[:, s]]) for s in subs]
        total, term = (np.empty((min(ROW_TILE, len(codes)), len(tile)), dtype=np.float32) for _ in range(2))
        for a in range(0, len(codes), ROW_TILE):
            some = codes[a:a + ROW_TILE]
            apart, more = total[:len(some)], term[:len(some)]
            np.take(to_tile[0], some[:, 0], axis=0, out=apart, mode="clip")  # unlike "raise", "clip" writes without a copy
            for s in subs[1:]:
                np.take(to_tile[s], some[:, s], axis=0, out=more, mode="clip")
                apart += more
            best = apart.argmin(axis=1)
            near = apart[np.arange(len(some)), best] * np.float32(1 + SLACK) + np.float32(1e-30)
            d = tables[subs[None, :], some, tile[best]].sum(axis=1)
            close = apart <= near[:, None]
            tied = np.flatnonzero(np.count_nonzero(close, axis=1) > 1) if np.count_nonzero(close) > len(some) else subs[:0]
            for r in tied.tolist():
                others = np.flatnonzero(apart[r] <= near[r])
                exact = tables[subs[None, :], some[r][None, :], tile[others]].sum(axis=1)
                best[r], d[r] = others[exact.argmin()], exact.min()
            better = d < least[a:a + ROW_TILE]
            label[a:a + ROW_TILE] = np.where(better, best + c, label[a:a + ROW_TILE])
            least[a:a + ROW_TILE] = np.where(better, d, least[a:a + ROW_TILE])
    return label, least


def code_histogram(labelled: DataFrame, codes_col: str = "codes", cluster_col: str = "cluster_id") -> DataFrame:
    """(cluster_id, sub, code, n), combined before the shuffle."""
    weight = F.sum("weight") if "weight" in labelled.columns else F.count("*")
    keep = [c for c in ("weight",) if c in labelled.columns]
    each = labelled.select(F.col(cluster_col).alias("cluster_id"), *keep, F.posexplode(codes_col).alias("sub", "code"))
    return each.groupBy("cluster_id", "sub", "code").agg(weight.alias("n"))


def updated_centers(histogram: DataFrame, tables: np.ndarray, previous: np.ndarray) -> np.ndarray:
    """Of each cluster and subspace the codeword with the least total distance to its rows' codes, any
    of the whole codebook, the lowest of equal ones; an empty cluster keeps its center."""

    @F.pandas_udf("int")
    def medoid(sub: pd.Series, held: pd.Series) -> pd.Series:
        out = []
        for s, pairs in zip(sub, held):
            code = np.array([p["code"] for p in pairs])
            n = np.array([p["n"] for p in pairs], dtype=np.float64)
            out.append(int((n @ tables[s][code]).argmin()))
        return pd.Series(out, dtype="int32")

    # a list has at most as many entries as the codebook
    held = histogram.groupBy("cluster_id", "sub").agg(F.collect_list(F.struct("code", "n")).alias("held"))
    new = previous.copy()
    for r in held.select("cluster_id", "sub", medoid("sub", "held").alias("code")).collect():  # K * m numbers
        new[r.cluster_id, r.sub] = r.code
    return new


@dataclass
class PQKMeansModel(Model):
    pq: PQModel
    centers: np.ndarray
    iterations_run: int = 0

    @classmethod
    def from_centers(cls, pq: PQModel, centers: np.ndarray | DataFrame) -> PQKMeansModel:
        """A model of given centers (K, m), or of a frame as ``centers_frame`` gives it; it counts as fitted."""
        if isinstance(centers, DataFrame):
            centers = [r.codes for r in centers.orderBy("cluster_id").select("codes").collect()]  # K * m numbers
        centers = np.asarray(centers, dtype=np.int64)
        if centers.ndim != 2 or centers.shape[1] != pq.m or not len(centers) or centers.min() < 0 or centers.max() >= pq.k:
            raise ValueError(f"centers must be rows of {pq.m} codes below {pq.k}")
        return cls(pq, centers)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.assign(df)

    predict = transform

    def _relational(self, df: DataFrame, codes_col: str, cluster_col: str, with_distance: bool) -> DataFrame:
        """Every row meets every center in SQL expressions: the centers' and tables' literals make it one for few of both."""
        tables = self.pq.distance_tables()
        far = []
        for center in self.centers:
            terms = [F.element_at(F.array(*map(F.lit, tables[s][:, c].tolist())), F.col(codes_col)[s].cast("int") + 1) for s, c in enumerate(center.tolist())]
            far.append(sum(terms[1:], terms[0]))
        out = df.withColumn("_far", F.array(*far)).withColumn("distance", F.array_min("_far"))
        out = out.withColumn(cluster_col, (F.array_position("_far", F.col("distance")) - 1).cast("int")).drop("_far")
        return out if with_distance else out.drop("distance")

    def assign(self, df: DataFrame, codes_col: str = "codes", with_distance: bool = False, cluster_col: str = "cluster_id", strategy: str = "auto") -> DataFrame:
        """Adds the label, and the distance; one narrow pass with the centers broadcast.

        ``strategy``: "vectorized" in Arrow batches, "relational" in SQL expressions; "auto" takes the former.
        """
        if strategy == "relational":
            return self._relational(df, codes_col, cluster_col, with_distance)
        if strategy not in ("auto", "vectorized"):
            raise ValueError(f"strategy {strategy!r} is not auto, vectorized or relational")
        centers, tables = self.centers, self.pq.distance_tables()

        @F.pandas_udf("struct<label int, distance double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    yield pd.DataFrame({"label": pd.Series(dtype="int32"), "distance": pd.Series(dtype="float64")})
                    continue
                label, d = closest(np.stack(batch.to_list()).astype(np.int64), centers, tables)
                yield pd.DataFrame({"label": label, "distance": d})

        out = df.withColumn("_found", run(F.col(codes_col)))
        out = out.withColumn(cluster_col, F.col("_found.label"))
        return (out.withColumn("distance", F.col("_found.distance")) if with_distance else out).drop("_found")

    def centers_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, [int(x) for x in c]) for k, c in enumerate(self.centers)], "cluster_id int, codes array<int>")

    def avg_distance(self, labelled: DataFrame, codes_col: str = "codes", cluster_col: str = "cluster_id") -> DataFrame:
        """(avg_distance) by looking each row's distance to its own center up, without comparing centers."""
        spark = labelled.sparkSession
        own = self.centers_frame(spark).select(F.col("cluster_id").alias("own"), F.posexplode("codes").alias("sub", "c2"))
        each = labelled.select(F.monotonically_increasing_id().alias("row"), F.col(cluster_col).alias("own"), F.posexplode(codes_col).alias("sub", "c1"))
        apart = each.join(own, ["own", "sub"]).join(self.pq.distance_frame(spark), ["sub", "c1", "c2"])
        return apart.agg((F.sum("d") / F.sum(F.when(F.col("sub") == 0, 1))).alias("avg_distance"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.pq.save(spark, f"{path}/pq")
        self.centers_frame(spark).write.mode("overwrite").parquet(f"{path}/centers")
        spark.createDataFrame([(json.dumps({"type": "pqkmeans", "version": 1, "k": len(self.centers)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PQKMeansModel:
        meta = json.loads(spark.read.text(f"{path}/metadata").first().value)
        if meta.get("type") != "pqkmeans":
            raise TypeError(f"{path} holds a {meta.get('type')} model, not a pqkmeans model")
        rows = spark.read.parquet(f"{path}/centers").orderBy("cluster_id").collect()
        return cls(PQModel.load(spark, f"{path}/pq"), np.array([r.codes for r in rows]))


@dataclass
class PQKMeans(Estimator):
    """Assign, count codes, move centers, until at most ``tol`` of the codes of centers change or two states alternate.

    ``dedupe`` first groups equal codes, which pays where they repeat: labels depend on codes only.
    """

    pq: PQModel
    k: int
    iterations: int = 20
    tol: float = 1e-3
    seed: int = 0
    init: str = "first"
    dedupe: bool = False
    history: list[float] = field(default_factory=list)

    def __post_init__(self):
        if not isinstance(self.pq, PQModel):
            raise ValueError("a fitted PQModel is needed")

    def fit(self, df: DataFrame, codes_col: str = "codes", id_col: str = "id") -> PQKMeansModel:
        rows = df.select(F.col(id_col).alias("id"), F.col(codes_col).alias("codes")).persist()
        try:
            return self._fit(rows)
        finally:
            rows.unpersist()

    def _fit(self, rows: DataFrame) -> PQKMeansModel:
        drawn = F.md5(F.concat_ws("|", F.lit(str(self.seed)), F.col("id").cast("string")))
        first = rows.orderBy(*(["id"] if self.init == "first" else [drawn, F.col("id")])).limit(self.k).collect()
        if not first:
            raise ValueError("there are no codes")
        centers = np.array([first[j % len(first)].codes for j in range(self.k)], dtype=np.int64)
        work = rows.groupBy("codes").agg(F.count("*").alias("weight")) if self.dedupe else rows.select("codes")
        work = work.persist() if self.dedupe else work
        tables, before = self.pq.distance_tables(), None
        self.history = []
        for _ in range(self.iterations):
            labelled = PQKMeansModel(self.pq, centers).assign(work)
            new = updated_centers(code_histogram(labelled), tables, centers)
            self.history.append(float((new != centers).mean()))
            alternates = before is not None and (new == before).all()
            before, centers = centers, new
            if self.history[-1] <= self.tol or alternates:
                break
        if self.dedupe:
            work.unpersist()
        return PQKMeansModel(self.pq, centers, len(self.history))

    def fit_predict(self, df: DataFrame, codes_col: str = "codes", id_col: str = "id") -> DataFrame:
        """The rows with labels of the final centers."""
        return self.fit(df, codes_col, id_col).assign(df, codes_col)
