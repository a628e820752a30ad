"""From molecule files to a table of clusters, in stages that a rerun takes up where they ended."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.fingerprints import featurize
from tessera.operators.pq import PQEncoder, PQModel, auto_m
from tessera.operators.pqkmeans import PQKMeans, PQKMeansModel
from tessera.sources.paths import _fs
from tessera.sources.text import scan_text, share_drawn


@dataclass(frozen=True)
class Config:
    """``source`` has a SMILES in column ``col`` of each line; ``out`` gets all stages' tables and models."""

    source: str
    out: str
    col: int = 0
    kind: str = "mqn"
    params: tuple[tuple[str, int], ...] = ()
    n_train: int = 1_000_000  # about so many: rows are drawn by a threshold
    k_codes: int = 256
    m: int | None = None
    pq_iterations: int = 20
    k_clusters: int = 1000
    iterations: int = 20
    tol: float = 1e-3
    seed: int = 0
    integer: bool = False  # codewords are whole numbers

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)


STAGES = ("features", "encoder", "codes", "clusters", "assigned")


class Pipeline:
    """Molecules are read and described once; later stages read what is stored.

    Starts are drawn by the SMILES, so a seed gives the same result however the input is split into files.
    """

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config

    def _done(self, stage: str) -> bool:
        fs, where = _fs(self.spark, f"{self.config.out}/{stage}.done")
        if not fs.exists(where):
            return False
        return self.spark.read.text(where.toString()).first().value == self.config.to_json()

    def _mark(self, stage: str) -> None:
        self.spark.createDataFrame([(self.config.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.config.out}/{stage}.done")

    def run(self, resume: bool = True) -> DataFrame:
        """(smiles, cluster_id).  With ``resume``, stages done under this same configuration are kept."""
        fresh = not resume
        for stage in STAGES:
            fresh = fresh or not self._done(stage)
            if fresh:
                getattr(self, stage)()
                self._mark(stage)
        return self.spark.read.parquet(f"{self.config.out}/assigned")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.config.out}/{name}")

    def features(self) -> None:
        c = self.config
        rows = featurize(scan_text(self.spark, c.source, c.col), c.kind, **dict(c.params))
        rows.write.mode("overwrite").parquet(f"{c.out}/features")

    def encoder(self) -> None:
        c, rows = self.config, self._table("features")
        # drawn once by a hash threshold and stored, so every iteration reads all its partitions in parallel
        share_drawn(rows, c.n_train, c.seed, "smiles").select("smiles", "fp").write.mode("overwrite").parquet(f"{c.out}/train")
        train = self._table("train")
        m = c.m or auto_m(rows.select(F.size("fp")).first()[0])
        PQEncoder(c.k_codes, m, c.pq_iterations, c.seed, "random", c.integer).fit(train, id_col="smiles").save(self.spark, f"{c.out}/encoder")

    def codes(self) -> None:
        PQModel.load(self.spark, f"{self.config.out}/encoder").encode(self._table("features")).drop("fp").write.mode("overwrite").parquet(f"{self.config.out}/codes")

    def clusters(self) -> None:
        c = self.config
        model = PQKMeans(PQModel.load(self.spark, f"{c.out}/encoder"), c.k_clusters, c.iterations, c.tol, c.seed, "random", dedupe=True)
        model.fit(self._table("codes"), id_col="smiles").save(self.spark, f"{c.out}/clusters")

    def assigned(self) -> None:
        model = PQKMeansModel.load(self.spark, f"{self.config.out}/clusters")
        model.assign(self._table("codes")).select("smiles", "cluster_id").write.mode("overwrite").parquet(f"{self.config.out}/assigned")
