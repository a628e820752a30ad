"""Product quantisation: codebooks, codes, and tables of distances between codewords."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.base import Estimator, Model

#: Bytes of differences that an encoder holds at once.
BLOCK_BYTES = 32 << 20


def auto_m(dim: int) -> int:
    """Subvectors that suit a dimension."""
    fixed = {42: 6, 1024: 8, 2048: 8}
    if dim in fixed:
        return fixed[dim]
    for m in (8, 6, 4):
        if dim % m == 0:
            return m
    raise ValueError(f"no default number of subvectors divides {dim}")


def code_type(k: int) -> str:
    """The Spark type that holds codes below k; Spark has no unsigned types."""
    return "smallint" if k <= 256 else "int" if k <= 65_536 else "bigint"


def compression(dim: int, m: int) -> float:
    """Of float32 vectors to one byte for each of m codes."""
    return dim * 4 / m


#: Share of the squared lengths by which the product form may be off; what comes this close is compared by differences.
SLACK = 1e-11


def nearest(x: np.ndarray, codewords: np.ndarray) -> np.ndarray:
    """Codes (n, m) of rows; of equal distances the lowest code.

    |c|^2 - 2 x.c ranks the codewords by a matrix product; rows for which several codewords come
    within rounding of the least are decided by exact differences.
    """
    m, k, width = codewords.shape
    out = np.empty((len(x), m), dtype=np.int64)
    rows = max(1, BLOCK_BYTES // (8 * k))
    for s in range(m):
        words = codewords[s]
        square, turned = (words * words).sum(axis=1), np.ascontiguousarray(-2 * words.T)
        for a in range(0, len(x), rows):
            part = x[a:a + rows, s * width:(s + 1) * width]
            apart = part @ turned
            apart += square
            least = apart.min(axis=1)
            slack = SLACK * ((part * part).sum(axis=1) + square.max(initial=0.0))
            close = apart <= (least + slack)[:, None]
            code = close.argmax(axis=1)
            for r in np.flatnonzero(np.count_nonzero(close, axis=1) > 1).tolist():
                some = np.flatnonzero(close[r])
                code[r] = some[((part[r] - words[some]) ** 2).sum(axis=1).argmin()]
            out[a:a + rows, s] = code
    return out


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_list()).astype(np.float64) if len(values) else np.zeros((0, 0))


def _apart_from(part: Column) -> Callable[[Column], Column]:
    """The squared distance of a codeword to ``part``."""
    return lambda w: F.aggregate(F.zip_with(part, w, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)


@dataclass
class PQModel(Model):
    """A fitted codebook: float64 (m, k, width)."""

    codewords: np.ndarray

    @property
    def m(self) -> int:
        return self.codewords.shape[0]

    @property
    def k(self) -> int:
        return self.codewords.shape[1]

    @property
    def dim(self) -> int:
        return self.m * self.codewords.shape[2]

    def encode_column(self, vector: Column | str) -> Column:
        words = self.codewords

        @F.pandas_udf(f"array<{code_type(self.k)}>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(list(nearest(_matrix(batch), words)) if len(batch) else [], dtype=object)

        return run(vector)

    def encode(self, df: DataFrame, vector_col: str = "fp", out_col: str = "codes", strategy: str = "auto") -> DataFrame:
        """Adds the codes; rows without a vector are dropped.

        ``strategy``: "vectorized" is one narrow pass in Arrow batches, "relational" the same in SQL
        expressions with the codebook as a literal, for small codebooks; "auto" takes the former.
        """
        rows = df.where(F.col(vector_col).isNotNull())
        if strategy == "relational":
            return rows.withColumn(out_col, self._relational(F.col(vector_col)))
        if strategy not in ("auto", "vectorized"):
            raise ValueError(f"strategy {strategy!r} is not auto, vectorized or relational")
        return rows.withColumn(out_col, self.encode_column(vector_col))

    transform = encode

    def _relational(self, vector: Column) -> Column:
        width = self.codewords.shape[2]
        codes = []
        for s in range(self.m):
            part = F.transform(F.slice(vector, s * width + 1, width), lambda v: v.cast("double"))
            words = F.array(*[F.array(*map(F.lit, map(float, w))) for w in self.codewords[s]])

            d = F.transform(words, _apart_from(part))
            codes.append((F.array_position(d, F.array_min(d)) - 1).cast(code_type(self.k)))
        return F.array(*codes)

    def inverse_transform(self, df: DataFrame, codes_col: str = "codes", out_col: str = "decoded", binary: bool = False, round: bool = True) -> DataFrame:
        return self.decode(df, codes_col, out_col, binary, round)

    def decode(self, df: DataFrame, codes_col: str = "codes", out_col: str = "decoded", binary: bool = False, round: bool = True) -> DataFrame:
        """Adds the vector of the codewords: 0/1 by a threshold of 0.6, or cut towards zero, or as it is."""
        words = self.codewords

        @F.pandas_udf("array<double>")
        def run(codes: pd.Series) -> pd.Series:
            if not len(codes):
                return pd.Series([], dtype=object)
            c = np.stack(codes.to_list())
            if c.ndim != 2 or c.shape[1] != words.shape[0]:
                raise ValueError(f"codes must have {words.shape[0]} entries")
            return pd.Series(list(np.concatenate([words[s][c[:, s]] for s in range(words.shape[0])], axis=1)))

        raw = run(F.col(codes_col))
        if binary:
            return df.withColumn(out_col, raw).withColumn(out_col, F.transform(out_col, lambda x: (x >= 0.6).cast("tinyint")))
        if round:
            return df.withColumn(out_col, raw).withColumn(out_col, F.transform(out_col, lambda x: x.cast("int")))
        return df.withColumn(out_col, raw)

    def distance_tables(self) -> np.ndarray:
        """Squared distances (m, k, k) between codewords, by exact differences in blocks of bounded size."""
        out = np.empty((self.m, self.k, self.k))
        rows = max(1, BLOCK_BYTES // (8 * self.codewords[0].size))
        for s, words in enumerate(self.codewords):
            for a in range(0, self.k, rows):
                apart = words[a:a + rows, None, :] - words[None, :, :]
                out[s, a:a + rows] = np.einsum("abd,abd->ab", apart, apart)
        return out

    def distance_frame(self, spark: SparkSession) -> DataFrame:
        """(sub, c1, c2, d)."""
        t = self.distance_tables()
        s, a, b = np.indices(t.shape)
        return spark.createDataFrame(pd.DataFrame({"sub": s.ravel().astype("int32"), "c1": a.ravel().astype("int32"), "c2": b.ravel().astype("int32"), "d": t.ravel()}))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(s, c, [float(x) for x in self.codewords[s, c]]) for s in range(self.m) for c in range(self.k)]
        spark.createDataFrame(rows, "sub int, code int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/codewords")
        spark.createDataFrame([(json.dumps({"type": "pq", "version": 1, "k": self.k, "m": self.m}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PQModel:
        meta = json.loads(spark.read.text(f"{path}/metadata").first().value)
        if meta.get("type") != "pq":
            raise TypeError(f"{path} holds a {meta.get('type')} model, not a pq model")
        rows = spark.read.parquet(f"{path}/codewords").orderBy("sub", "code").collect()
        return cls(np.array([r.centroid for r in rows]).reshape(meta["m"], meta["k"], -1))


@dataclass
class PQEncoder(Estimator):
    """Lloyd's algorithm in every subspace at once, one Spark job an iteration.

    ``init``: "first" rows by the id, "random" ones by a seeded hash, or "kmeans++" on a bounded
    sample.  ``integer`` floors centroids, which keeps integer vectors exact.  A codeword that
    no row is nearest to stays as it is.
    """

    k: int = 256
    m: int = 8
    iterations: int = 20
    seed: int = 0
    init: str = "first"
    integer: bool = False
    sample: int = 20_000
    model: PQModel | None = field(default=None, repr=False)
    _fitted: bool = field(default=False, repr=False)

    def fit_transform(self, df: DataFrame, vector_col: str = "fp", id_col: str = "id", out_col: str = "codes") -> DataFrame:
        """The rows with the codes of a codebook fitted on them; ``model`` then has it."""
        self.model = self.fit(df, vector_col, id_col)
        return self.model.encode(df, vector_col, out_col)

    def fit(self, df: DataFrame, vector_col: str = "fp", id_col: str = "id") -> PQModel:
        """Reads the rows once: they are kept in memory or on disk while it runs."""
        if self._fitted:
            raise AssertionError("the encoder is already fitted")
        rows = df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        rows = rows.persist()
        try:
            return self._fit(rows)
        finally:
            rows.unpersist()

    def _fit(self, rows: DataFrame) -> PQModel:
        shape = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
        if shape.low != shape.high:
            raise AssertionError("vectors of one length are needed")
        if not self.k < shape.n:
            raise AssertionError(f"k={self.k} must be below the number of vectors, {shape.n}")
        if shape.low % self.m:
            raise AssertionError(f"the dimension {shape.low} must be divisible by m={self.m}")
        words = self._start(rows, shape.low // self.m)
        for _ in range(self.iterations):
            words = self._step(rows, words)
        self._fitted = True
        return PQModel(words)

    def _start(self, rows: DataFrame, width: int) -> np.ndarray:
        drawn = F.md5(F.concat_ws("|", F.lit(str(self.seed)), F.col("id").cast("string")))
        order = ["id"] if self.init == "first" else [drawn, F.col("id")]
        n = self.sample if self.init == "kmeans++" else self.k
        x = np.array([r.v for r in rows.orderBy(*order).limit(max(n, self.k)).collect()])
        x = x.reshape(len(x), self.m, width)
        if self.init in ("first", "random"):
            return x[:self.k].transpose(1, 0, 2).copy()
        if self.init != "kmeans++":
            raise ValueError(f"unknown init {self.init!r}")
        rnd, out = np.random.default_rng(self.seed), np.empty((self.m, self.k, width))
        for s in range(self.m):
            out[s, 0] = x[rnd.integers(len(x)), s]
            least = ((x[:, s] - out[s, 0]) ** 2).sum(axis=1)
            for c in range(1, self.k):
                p = least / least.sum() if least.sum() > 0 else None
                out[s, c] = x[rnd.choice(len(x), p=p), s]
                least = np.minimum(least, ((x[:, s] - out[s, c]) ** 2).sum(axis=1))
        return out

    def _step(self, rows: DataFrame, words: np.ndarray) -> np.ndarray:
        m, k, width = words.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((m, k, width)), np.zeros((m, k), dtype=np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                codes = nearest(x, words)
                for s in range(m):
                    counts[s] += np.bincount(codes[:, s], minlength=k)
                    for d in range(width):
                        sums[s, :, d] += np.bincount(codes[:, s], weights=x[:, s * width + d], minlength=k)
            s, c, d = np.indices(sums.shape)
            some = np.broadcast_to(counts[:, :, None] > 0, sums.shape)
            yield pa.RecordBatch.from_arrays([pa.array(a[some]) for a in (s.astype(np.int32), c.astype(np.int32), d.astype(np.int32), sums, np.broadcast_to(counts[:, :, None], sums.shape))], names=["sub", "code", "dim", "total", "n"])

        parts = rows.select("v").mapInArrow(run, "sub int, code int, dim int, total double, n long")
        new = words.copy()
        for r in parts.groupBy("sub", "code", "dim").agg((F.sum("total") / F.sum("n")).alias("mean")).collect():  # m * k * width numbers
            new[r.sub, r.code, r.dim] = np.floor(r["mean"]) if self.integer else r["mean"]
        return new


def recon_error(df: DataFrame, vector_col: str, decoded_col: str) -> DataFrame:
    """(mse, rmse, fidelity) of decoded vectors: fidelity is 100 (1 - |X - X'| / |X|) in Frobenius norms."""
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    apart = F.zip_with(F.col(vector_col).cast("array<double>"), F.col(decoded_col).cast("array<double>"), lambda a, b: a - b)
    sums = df.agg(F.sum(square(apart)).alias("e"), F.sum(square(F.col(vector_col).cast("array<double>"))).alias("x"), F.sum(F.size(vector_col)).alias("n"))
    mse = F.col("e") / F.col("n")
    return sums.select(mse.alias("mse"), F.sqrt(mse).alias("rmse"), ((1 - F.sqrt("e") / F.sqrt("x")) * 100).alias("fidelity"))


def split_vectors(df: DataFrame, m: int, vector_col: str = "fp", id_col: str = "id") -> DataFrame:
    """(id, sub, part): the m subvectors of each vector."""
    width = (F.size(vector_col) / m).cast("int")
    each = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("sub"))
    return each.select("id", "sub", F.expr("slice(v, sub * w + 1, w)").alias("part"))
