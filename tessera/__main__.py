"""Command line: ``python -m tessera COMMAND ...``; every command reads and writes through Spark."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.fingerprints import featurize
from tessera.operators import clusters, graph, metrics
from tessera.operators.pq import PQEncoder, PQModel, auto_m
from tessera.operators.pqkmeans import PQKMeans, PQKMeansModel
from tessera.plans.pipeline import Config, Pipeline
from tessera.plans.progress import Throughput, timed
from tessera.sources.arrays import gen_codes, scan_codes, scan_npy, to_array
from tessera.sources.paths import expand_paths, results
from tessera.sources.text import pick_token, scan_text, share_drawn, subsample
from tessera.streaming.assign import stream_assign

COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], None]] = {}
ARGUMENTS: dict[str, tuple[str, list[tuple[tuple[str, ...], dict]]]] = {}


def command(name: str, says: str, *arguments: tuple[str, ...] | tuple[tuple[str, ...], dict]):
    """Registers a function as a command; an argument is its name, or its names and options."""

    def put(function: Callable[[SparkSession, argparse.Namespace], None]):
        COMMANDS[name] = timed(function)
        ARGUMENTS[name] = (says, [((a,), {}) if isinstance(a, str) else ((a[0],), a[1]) for a in arguments])
        return function

    return put


def option(name: str, kind: type | None = str, value: object = None, **more) -> tuple[str, dict]:
    return f"--{name}", {"type": kind, "default": value, **more}


FINGERPRINT = (option("kind", str, "mqn"), option("bits", int, 1024), option("radius", int, 3))


def _params(a: argparse.Namespace) -> dict[str, int]:
    return {"fp_size": a.bits, "radius": a.radius} if a.kind == "morgan" else {}


def _vectors(spark: SparkSession, source: str) -> DataFrame:
    """(id, fp) of .npy or .npz arrays, or of Parquet with an array column fp or wide columns fp_0, fp_1, ..."""
    files = expand_paths(spark, source)
    if any(f.endswith((".npy", ".npz")) for f in files):
        rows = scan_npy(spark, files)
    else:
        rows = spark.read.parquet(source)
        rows = rows if "fp" in rows.columns else to_array(rows, name="fp", prefixes=("fp_",))
    return rows if "id" in rows.columns else rows.withColumn("id", F.monotonically_increasing_id())


def _codes(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(id, codes, ...) of Parquet with an array column codes, or of wide columns, .csv, .npy or .npz files."""
    wide = a.columns or not all(f.endswith(".parquet") for f in expand_paths(spark, a.codes)) or "codes" not in spark.read.parquet(a.codes).columns
    rows = scan_codes(spark, a.codes, a.columns) if wide else spark.read.parquet(a.codes)
    return rows if "id" in rows.columns else rows.withColumn("id", F.monotonically_increasing_id())


@command("run", "molecule files to clusters, in stages that a rerun takes up", "source", "out", option("col", int, 0), option("kind", str, "mqn"), option("n-train", int, 1_000_000), option("k-codes", int, 256), option("m", int), option("pq-iterations", int, 20), option("k-clusters", int, 1000), option("iterations", int, 20), option("tol", float, 1e-3), option("seed", int, 0), ("--no-resume", {"action": "store_true"}))
def run(spark: SparkSession, a: argparse.Namespace) -> None:
    names = {"col", "kind", "n_train", "k_codes", "m", "pq_iterations", "k_clusters", "iterations", "tol", "seed"}
    Pipeline(spark, Config(a.source, a.out, **{k: v for k, v in vars(a).items() if k in names})).run(not a.no_resume)


@command("features", "molecule files to fingerprints", "source", "out", option("col", int, 0), *FINGERPRINT)
def features(spark: SparkSession, a: argparse.Namespace) -> None:
    featurize(scan_text(spark, a.source, a.col), a.kind, **_params(a)).write.parquet(a.out)


@command("train", "fingerprints to a codebook", "features", "model", option("k", int, 256), option("m", int), option("iterations", int, 20), option("seed", int, 0), option("n-train", int))
def train(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _vectors(spark, a.features)
    rows = share_drawn(rows, a.n_train, a.seed, "id") if a.n_train else rows
    m = a.m or auto_m(rows.select(F.size("fp")).first()[0])
    PQEncoder(a.k, m, a.iterations, a.seed, "random").fit(rows).save(spark, a.model)


@command("encode", "molecule files to codes", "source", "model", "out", option("col", int, 0), *FINGERPRINT)
def encode(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = featurize(scan_text(spark, a.source, a.col), a.kind, **_params(a))
    PQModel.load(spark, a.model).encode(rows).select("smiles", "codes").write.parquet(a.out)


CODES = ("codes", ("--columns", {"nargs": "*"}))


@command("fit", "codes to cluster centers, and with --labels to labels of the codes", *CODES, "encoder", "model", option("k", int, 1000), option("iterations", int, 20), option("tol", float, 1e-3), option("seed", int, 0), option("labels"))
def fit(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _codes(spark, a)
    model = PQKMeans(PQModel.load(spark, a.encoder), a.k, a.iterations, a.tol, a.seed, "random", dedupe=True).fit(rows)
    model.save(spark, a.model)
    if a.labels:
        model.predict(rows).write.parquet(a.labels)


@command("label", "codes to labels of trained clusters", *CODES, "model", "out", ("--with-distance", {"action": "store_true"}))
def label(spark: SparkSession, a: argparse.Namespace) -> None:
    PQKMeansModel.load(spark, a.model).assign(_codes(spark, a), with_distance=a.with_distance).write.parquet(a.out)


@command("sweep", "metrics of several numbers of clusters; without --codes of uniform codes", "encoder", "out", option("codes"), ("--columns", {"nargs": "*"}), ("--k", {"type": int, "nargs": "+", "required": True}), option("iterations", int, 10), option("n-subsample", int), option("seed", int, 0), option("plot"))
def sweep(spark: SparkSession, a: argparse.Namespace) -> None:
    pq = PQModel.load(spark, a.encoder)
    rows = _codes(spark, a) if a.codes else gen_codes(spark, a.n_subsample or 100_000, pq.m, pq.k, a.seed)
    rows = subsample(rows, a.n_subsample, a.seed, "id") if a.codes and a.n_subsample else rows
    found = metrics.k_sweep(spark, rows, pq, a.k, a.out, a.iterations)
    found.show(1000, False)
    if a.plot:
        metrics.k_plot(found, a.plot)


@command("assign", "new files to clusters of a trained model, each file once", "source", "model", "out", "checkpoint", option("col", int, 0), *FINGERPRINT)
def assign(spark: SparkSession, a: argparse.Namespace) -> None:
    listener = Throughput()
    spark.streams.addListener(listener)
    stream_assign(spark, a.source, PQKMeansModel.load(spark, a.model), a.out, a.checkpoint, a.col, a.kind, **_params(a)).awaitTermination()
    spark.streams.removeListener(listener)


@command("stats", "sizes of clusters", "results")
def stats(spark: SparkSession, a: argparse.Namespace) -> None:
    clusters.cluster_stats(results(spark, a.results)).show(1000, False)


@command("sample", "some rows of a cluster", "results", ("cluster", {"type": int}), option("n", int, 100), option("seed", int))
def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    clusters.sample_from_cluster(results(spark, a.results), a.cluster, a.n, a.seed).show(a.n, False)


@command("export", "one cluster to a file, or all to folders", "results", "path", option("cluster", int))
def export(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = results(spark, a.results)
    print(clusters.export_all_clusters(rows, a.path) if a.cluster is None else clusters.export_cluster(rows, a.cluster, a.path))


def molecules(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Of a results folder, of a CSV or Parquet file with smiles and perhaps cluster_id, or the lines of a SMILES file."""
    if a.results:
        return results(spark, a.results)
    if a.cluster_file:
        csv = a.cluster_file.lower().endswith(".csv")
        rows = spark.read.csv(a.cluster_file, header=True, inferSchema=True) if csv else spark.read.parquet(a.cluster_file)
        if "smiles" not in rows.columns:
            raise ValueError(f"{a.cluster_file} has no column smiles")
        return rows
    if a.smiles:
        return pick_token(spark.read.text(expand_paths(spark, a.smiles)).where(F.trim("value") != ""))
    raise ValueError("a map needs --results, --cluster-file or --smiles")


@command("map", "a tree map: of molecules, of a cluster, or with --representative of one molecule of each", "path", option("results"), option("cluster-file"), option("smiles"), option("cluster", int), ("--representative", {"action": "store_true"}), option("kind", str, "morgan"), option("bits", int, 2048), option("radius", int, 2), option("k", int, 20), ("--properties", {"nargs": "*"}))
def tree_map(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = molecules(spark, a)
    own = "cluster_id" in rows.columns
    if (a.representative or a.cluster is not None) and not own:
        raise ValueError("there is no column cluster_id")
    if a.representative:
        graph.representative_map(clusters.representatives(rows, 0), a.path, a.kind, a.k, a.properties, **_params(a))
        return
    rows = clusters.query_cluster(rows, a.cluster, warn=True) if a.cluster is not None else rows
    graph.tree_map(rows, a.path, a.kind, a.k, None, a.properties, "cluster_id" if own else None, **_params(a))


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="tessera")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (says, arguments) in ARGUMENTS.items():
        p = sub.add_parser(name, help=says)
        for names, options in arguments:
            p.add_argument(*names, **options)
    a = top.parse_args(argv)
    COMMANDS[a.command](SparkSession.builder.appName("tessera").getOrCreate(), a)


if __name__ == "__main__":
    main()
