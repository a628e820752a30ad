"""All queries of the engine by name, over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.fingerprints import featurize, mol_props
from tessera.functions.smiles import parse, to_molblock
from tessera.operators import clusters, graph, metrics
from tessera.operators.pq import PQEncoder, PQModel, auto_m, compression, recon_error, split_vectors
from tessera.operators.pqkmeans import PQKMeans, PQKMeansModel, code_histogram, updated_centers
from tessera.plans.catalog_sql import CLUSTERS, ORACLES, K, M  # noqa: F401
from tessera.plans.pipeline import Config, Pipeline
from tessera.sources import arrays, text
from tessera.sources.paths import _fs, expand_paths, results, shared_folder
from tessera.streaming.assign import stream_assign


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    return rows.select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("smiles"), (F.col("l_suppkey") % 16).cast("int").alias("cluster_id"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int")).alias("fp"))


def _pq(spark: SparkSession, sf_dir: str) -> tuple[PQModel, DataFrame]:
    """The codebook of the first K vectors, and all vectors' codes."""
    rows = _vectors(spark, sf_dir)
    model = PQEncoder(K, M, iterations=0).fit(rows)
    return model, model.encode(rows)


def _clustered(spark: SparkSession, sf_dir: str) -> tuple[PQKMeansModel, DataFrame]:
    """The first CLUSTERS codes as centers, and all codes with labels and distances."""
    pq, codes = _pq(spark, sf_dir)
    model = PQKMeans(pq, CLUSTERS, iterations=0).fit(codes)
    out = model.assign(codes, with_distance=True)
    return model, out.withColumn("distance", F.col("distance").cast("long"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))


def _molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of carbon with one end group, by the parts' sizes and keys."""
    group = F.element_at(F.array(*map(F.lit, ("", "O", "N", "Cl"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.expr("repeat('C', cast(1 + p_size % 12 as int))"), group).alias("smiles"))


def _joined(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


def _centers(spark: SparkSession, model: PQKMeansModel) -> DataFrame:
    return model.centers_frame(spark).select("cluster_id", F.posexplode("codes").alias("sub", "code"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors, codes, clusters, sizes."""
    return clusters.cluster_stats(_clustered(spark, sf_dir)[1])


def _export_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/cluster_7.parquet"
    clusters.export_cluster(_results(spark, sf_dir), 7, path)
    return spark.read.parquet(path)


def _export_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    clusters.export_all_clusters(_results(spark, sf_dir), folder)
    return clusters.cluster_stats(spark.read.parquet(folder))


def _pq_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, labelled = _clustered(spark, sf_dir)
    new = updated_centers(code_histogram(labelled), model.pq.distance_tables(), model.centers)
    return _centers(spark, PQKMeansModel(model.pq, new))


def _pq_fit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pq, codes = _pq(spark, sf_dir)
    return _centers(spark, PQKMeans(pq, CLUSTERS, iterations=2, tol=-1.0).fit(codes))


def _pq_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = PQEncoder(K, M, iterations=2, integer=True).fit(_vectors(spark, sf_dir)).codewords.astype(int)
    return spark.createDataFrame([(s, c, ",".join(map(str, words[s, c]))) for s in range(M) for c in range(K)], "sub int, code int, centroid string")


def _decoded(spark: SparkSession, sf_dir: str, binary: bool) -> DataFrame:
    model, codes = _pq(spark, sf_dir)
    return model.decode(codes, binary=binary).select("id", _joined("decoded"))


def _recon_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, codes = _pq(spark, sf_dir)
    found = recon_error(model.decode(codes, round=False), "fp", "decoded")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


def _k_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.k_metrics(_clustered(spark, sf_dir)[1], CLUSTERS)
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in found.dtypes])


def _avg_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, labelled = _clustered(spark, sf_dir)
    return model.avg_distance(labelled).select(F.round("avg_distance", 6).alias("avg_distance"))


def _label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _clustered(spark, sf_dir)[1]
    return clusters.label_agreement(labelled, _vectors(spark, sf_dir).select("id", F.col("label").alias("cluster_id")), "id")


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.knn_graph(_vectors(spark, sf_dir), 5).select("src", "dst", "rank", F.round("dist", 6).alias("dist"))


def _compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(d, auto_m(d), float(compression(d, auto_m(d)))) for d in (42, 1024, 2048, 64, 30, 20)], "d int, m int, ratio double")


def _mqn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featurize(_molecules(spark, sf_dir)).select("p_partkey", _joined("fp"))


def _morgan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many environments each distinct molecule has; so many bits keep them apart."""
    rows = featurize(_molecules(spark, sf_dir).select("smiles").distinct(), "morgan", fp_size=1 << 16, radius=2)
    return rows.select("smiles", F.aggregate("fp", F.lit(0).cast("long"), lambda n, x: n + x).alias("n_bits"))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("p_partkey") % 5 == 0, F.concat("smiles", F.lit(")"))).otherwise(F.col("smiles"))
    return featurize(_molecules(spark, sf_dir).withColumn("smiles", broken)).agg(F.count("*").alias("n_valid"))


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mol_props(_molecules(spark, sf_dir), ["n_heavy_atoms", "hba", "mw"]).select("p_partkey", "n_heavy_atoms", "hba", F.round("mw", 6).alias("mw"))


def _molecule_model(spark: SparkSession, sf_dir: str) -> PQKMeansModel:
    """Features are stored before the fits, whose iterations read them again and again."""
    folder = shared_folder(spark)
    featurize(_molecules(spark, sf_dir).withColumnRenamed("p_partkey", "id")).write.parquet(f"{folder}/features")
    rows = spark.read.parquet(f"{folder}/features")
    pq = PQEncoder(8, 6, iterations=2, integer=True).fit(rows)
    return PQKMeans(pq, 4, iterations=2, tol=-1.0).fit(pq.encode(rows))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    _molecules(spark, sf_dir).select("smiles").write.text(f"{folder}/in")
    stream_assign(spark, f"{folder}/in", _molecule_model(spark, sf_dir), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    _molecules(spark, sf_dir).select("smiles").write.text(f"{folder}/in")
    return Pipeline(spark, Config(f"{folder}/in", f"{folder}/out", k_codes=8, pq_iterations=2, k_clusters=4, iterations=2, tol=-1.0, integer=True)).run()


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pq, codes = _pq(spark, sf_dir)
    found = metrics.k_sweep(spark, codes, pq, [4, 8], f"{shared_folder(spark)}/sweep", iterations=2).drop("fit_time_s", "predict_time_s", "iterations")
    return found.select(*[F.round(c, 6).alias(c) if t == "double" and c != "inertia" else c for c, t in found.dtypes])


def _tree_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _molecules(spark, sf_dir).groupBy("smiles").agg(F.min("p_partkey").alias("id"))
    found = graph.tree_map(some, f"{shared_folder(spark)}/map.html", "mqn", k=5, properties=["mw"])
    return found.withColumn("dist", F.round("dist", 6))


def _scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    _lines(spark, sf_dir).select("value").write.text(f"{folder}/in")
    return text.scan_text(spark, f"{folder}/in", 1)


def _scan_sdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's molecule as a record of SD files, read back."""

    def record(smiles: pd.Series) -> pd.Series:
        return smiles.map(lambda x: to_molblock(parse(x)) + "$$$$")

    folder = shared_folder(spark)
    rows = _molecules(spark, sf_dir).select(F.pandas_udf(record, "string")("smiles").alias("value"))
    rows.write.text(f"{folder}/parts")
    files = [f for f in expand_paths(spark, f"{folder}/parts") if f.endswith(".txt")]
    fs, _ = _fs(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(f"{folder}/in"))
    for k, f in enumerate(files):
        fs.rename(path(f), path(f"{folder}/in/{k}.sdf"))
    return text.scan_text(spark, f"{folder}/in")


def _scan_npy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as .npy chunks of 150 rows, which the driver writes here as it would save chunks, read back in order."""
    folder = shared_folder(spark)
    x = np.array([r.fp for r in _vectors(spark, sf_dir).orderBy("id").collect()])
    for k, a in enumerate(range(0, len(x), 150)):
        arrays.save_chunk(x[a:a + 150], folder, k, spark=spark)
    rows = arrays.scan_npy(spark, folder)
    chunk = F.regexp_extract("file", "_([0-9]+)[.]npy$", 1).cast("long")
    return rows.select((chunk * 150 + F.col("row")).alias("row"), F.array_join(F.transform("fp", lambda v: v.cast("int").cast("string")), ",").alias("fp"))


def _scan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    arrays.to_wide(_pq(spark, sf_dir)[1].select("codes"), "codes", M, "pq_").write.parquet(f"{folder}/codes")
    return arrays.scan_codes(spark, f"{folder}/codes").select(_joined("codes"))


def _model_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and distances by a model that was saved and loaded."""
    folder = shared_folder(spark)
    _, codes = _pq(spark, sf_dir)
    _clustered(spark, sf_dir)[0].save(spark, folder)
    found = PQKMeansModel.load(spark, folder).assign(codes, with_distance=True)
    return found.select("id", "cluster_id", F.col("distance").cast("long").alias("distance"))


def _results_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes over a folder of chunks, of which one lacks a column that others have."""
    folder, rows = f"{shared_folder(spark)}/results", _results(spark, sf_dir)
    rows.where("cluster_id < 8").write.parquet(folder)
    rows.where("cluster_id >= 8").withColumn("extra", F.lit(1)).write.mode("append").parquet(folder)
    return clusters.cluster_stats(results(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "query_cluster": lambda s, d: clusters.query_cluster(_results(s, d), 3),
    "query_batch": lambda s, d: clusters.query_clusters_batch(_results(s, d), [1, 5, 9]),
    "cluster_stats": lambda s, d: clusters.cluster_stats(_results(s, d)),
    "cluster_ids": lambda s, d: clusters.cluster_ids(_results(s, d)),
    "total": lambda s, d: clusters.total(_results(s, d)),
    "top_clusters": lambda s, d: clusters.top_clusters(_results(s, d), 5),
    "largest_cluster": lambda s, d: clusters.largest_cluster(_results(s, d)),
    "sample_cluster": lambda s, d: clusters.sample_from_cluster(_results(s, d), 3, 100, 42),
    "representatives": lambda s, d: clusters.representatives(_results(s, d), 42),
    "export_cluster": _export_cluster,
    "export_all": _export_all,
    "scan_text": _scan_text,
    "scan_sdf": _scan_sdf,
    "scan_npy": _scan_npy,
    "scan_codes": _scan_codes,
    "model_io": _model_io,
    "results_folder": _results_folder,
    "chunk_ids": lambda s, d: text.chunk_ids(_lines(s, d), 3, "doc_id", "pos").groupBy("doc_id", "chunk").agg(F.count("*").alias("n")),
    "train_head": lambda s, d: text.train_head(_vectors(s, d), 100, "id").select("id", _joined("fp")),
    "subsample": lambda s, d: text.subsample(_vectors(s, d), 100, 7, "id").select("id", _joined("fp")),
    "pq_split": lambda s, d: split_vectors(_vectors(s, d), M).select("id", "sub", _joined("part")),
    "pq_encode": lambda s, d: _pq(s, d)[1].select("id", _joined("codes")),
    "unique_codes": lambda s, d: metrics.unique_codes(_pq(s, d)[1]),
    "pq_decode": lambda s, d: _decoded(s, d, False),
    "pq_decode_binary": lambda s, d: _decoded(s, d, True),
    "recon_error": _recon_error,
    "dist_tables": lambda s, d: _pq(s, d)[0].distance_frame(s).withColumn("d", F.col("d").cast("long")),
    "pq_assign": lambda s, d: _clustered(s, d)[1].select("id", "cluster_id"),
    "pq_assign_distance": lambda s, d: _clustered(s, d)[1].select("id", "cluster_id", "distance"),
    "code_hist": lambda s, d: code_histogram(_clustered(s, d)[1]).select("cluster_id", "sub", F.col("code").cast("int"), "n"),
    "pq_update": _pq_update,
    "pq_fit_codes_2iter": _pq_fit_codes,
    "pq_fit_2iter": _pq_fit,
    "avg_dist": _avg_dist,
    "k_metrics": _k_metrics,
    "n_used": lambda s, d: metrics.n_used(_clustered(s, d)[1]),
    "label_agreement": _label_agreement,
    "knn_graph": _knn,
    "compression": _compression,
    "mqn": _mqn,
    "featurize_valid": _valid,
    "mol_props": _props,
    "morgan": _morgan,
    "stream_assign": _stream,
    "cluster_pipeline": _pipeline,
    "k_sweep": _sweep,
    "tree_map": _tree_map,
}
