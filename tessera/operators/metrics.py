"""How good a clustering is, and which number of clusters to take."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.pq import PQModel
from tessera.operators.pqkmeans import PQKMeans
from tessera.sources.paths import _fs, write_text

SWEEP = "k int, inertia double, avg_dist double, n_empty_clusters long, pct_empty double, cluster_size_mean double, cluster_size_median double, cluster_size_std double, cluster_size_min long, cluster_size_max long, fit_time_s double, predict_time_s double, n_subsample long, iterations int"


def k_metrics(assigned: DataFrame, k: int, cluster_col: str = "cluster_id", distance_col: str = "distance") -> DataFrame:
    """One row: inertia, mean distance, empty clusters, and sizes over the others (population deviation)."""
    sizes = assigned.groupBy(cluster_col).agg(F.count("*").alias("size"), F.sum(distance_col).alias("d"))
    found = sizes.agg(
        F.sum("d").alias("inertia"), F.sum("size").alias("n"), F.count("*").alias("used"), F.avg("size").alias("cluster_size_mean"),
        F.median("size").alias("cluster_size_median"), F.stddev_pop("size").alias("cluster_size_std"), F.min("size").alias("cluster_size_min"), F.max("size").alias("cluster_size_max"),
    )
    empty = F.lit(k) - F.col("used")
    return found.select(
        F.lit(k).alias("k"), "inertia", (F.col("inertia") / F.col("n")).alias("avg_dist"), empty.cast("long").alias("n_empty_clusters"), (100.0 * empty / k).alias("pct_empty"),
        "cluster_size_mean", "cluster_size_median", "cluster_size_std", "cluster_size_min", "cluster_size_max",
    )


def n_used(labelled: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    return labelled.agg(F.countDistinct(cluster_col).alias("n_used"))


def unique_codes(df: DataFrame, codes_col: str = "codes") -> DataFrame:
    return df.select(codes_col).distinct().agg(F.count("*").alias("n_unique"))


def k_sweep(spark: SparkSession, codes: DataFrame, pq: PQModel, ks: Iterable[int], path: str, iterations: int = 10, id_col: str = "id") -> DataFrame:
    """Fits every k in order and appends its metrics to ``path``; ks found there, or not below the rows, are skipped."""
    fs, where = _fs(spark, path)
    done = {r.k for r in spark.read.schema(SWEEP).parquet(path).select("k").collect()} if fs.exists(where) else set()
    n = codes.count()
    for k in sorted(set(ks) - done):
        if k >= n:
            continue
        start = time.time()
        model = PQKMeans(pq, k, iterations).fit(codes, id_col=id_col)
        fitted = time.time()
        row = k_metrics(model.assign(codes, with_distance=True), k).first().asDict()
        row |= {"fit_time_s": fitted - start, "predict_time_s": time.time() - fitted, "n_subsample": n, "iterations": model.iterations_run}
        names = [c.split()[0] for c in SWEEP.split(", ")]
        spark.createDataFrame([tuple(row[c] for c in names)], SWEEP).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(SWEEP).parquet(path).orderBy("k")


def k_plot(sweep: DataFrame, path: str) -> None:
    """An SVG of three panels over k, one row for each k: mean distance, share of empty clusters, median and largest size."""
    rows = sweep.orderBy("k").collect()
    panels = [("mean distance", [[r.avg_dist for r in rows]]), ("empty clusters, %", [[r.pct_empty for r in rows]]), ("median and largest size", [[r.cluster_size_median for r in rows], [r.cluster_size_max for r in rows]])]
    out = ['<svg xmlns="http://www.w3.org/2000/svg" width="960" height="300" font-family="sans-serif" font-size="12">']
    low, high = (min(r.k for r in rows), max(r.k for r in rows)) if rows else (0, 1)
    for n, (title, lines) in enumerate(panels):
        left, most = 50 + 320 * n, max([v for line in lines for v in line if v is not None], default=0) or 1
        out.append(f'<text x="{left}" y="20">{title}</text><path d="M{left} 40V260H{left + 250}" fill="none" stroke="#888"/><text x="{left}" y="278">{low}</text><text x="{left + 250}" y="278" text-anchor="end">k = {high}</text><text x="{left - 4}" y="44" text-anchor="end">{most:.4g}</text>')
        for line, colour in zip(lines, ("#246", "#b52")):
            at = [(left + 250 * (r.k - low) / (high - low or 1), 260 - 220 * (v or 0) / most) for r, v in zip(rows, line)]
            out.append(f'<polyline fill="none" stroke="{colour}" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in at)}"/>')
            out += [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3" fill="{colour}"/>' for x, y in at]
    write_text(sweep.sparkSession, path, "\n".join([*out, "</svg>"]))
