"""Nearest-neighbour graphs of representatives, and maps of them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH, MinHashLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.fingerprints import PROPERTIES, featurize, mol_props
from tessera.sources.paths import write_text

#: Rows of a block; pairs of blocks are the unit of work of the exact graph.
BLOCK_ROWS = 1024
#: Rows up to which all pairs are compared, unless asked for, and molecules that one map may show.
EXACT_ROWS, MAP_ROWS = 200_000, 50_000


def _apart(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Squared Euclidean or Jaccard distances of all rows of two blocks by one matrix product."""
    if metric == "euclidean":
        return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0.0)
    a, b = a.astype(bool).astype(np.float64), b.astype(bool).astype(np.float64)
    both = a @ b.T
    either = a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - both
    return np.where(either > 0, 1 - both / np.maximum(either, 1), 0.0)


def _nearest(a: np.ndarray, own: np.ndarray, b: np.ndarray, others: np.ndarray, k: int, metric: str) -> list[tuple[int, int, float]]:
    """(row, other, distance): the k nearest others of each row of a block, equal distances by id."""
    apart = _apart(a, b, metric)
    apart[own[:, None] == others[None, :]] = np.inf
    wanted = min(k, len(others)) - 1
    reach = np.partition(apart, wanted, axis=1)[:, wanted]
    # what comes within rounding of the k-th is compared by exact differences
    reach = reach + 1e-9 * (1 + np.abs(reach) + ((a * a).sum(axis=1) if metric == "euclidean" else 0.0))
    at, to = np.nonzero((apart <= reach[:, None]) & np.isfinite(apart))
    d = np.sqrt(((a[at] - b[to]) ** 2).sum(axis=1)) if metric == "euclidean" else apart[at, to]
    order = np.lexsort((others[to], d, at))
    at, to, d = at[order], to[order], d[order]
    first = np.searchsorted(at, at)
    kept = np.arange(len(at)) - first < k
    return list(zip(own[at[kept]].tolist(), others[to[kept]].tolist(), d[kept].tolist()))


def knn_graph(df: DataFrame, k: int, metric: str = "euclidean", exact: bool | None = None, id_col: str = "id", vector_col: str = "fp", radius: float = 1.0) -> DataFrame:
    """(src, dst, dist, rank): each row's k nearest others, equal distances by id.

    Exact: rows are dealt in blocks and every pair of blocks is a group, whose task keeps k per row and side.
    Otherwise rows meet by locality-sensitive hashing within ``radius``.  None: exact up to EXACT_ROWS
    rows, as the work of all pairs grows with their square; representatives are fewer.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    many = rows.count()
    if exact is False or exact is None and many > EXACT_ROWS:
        vectors = rows.withColumn("features", array_to_vector("v"))
        lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=radius, numHashTables=4, seed=1) if metric == "euclidean" else MinHashLSH(inputCol="features", outputCol="h", numHashTables=8, seed=1)
        model = lsh.fit(vectors)
        pairs = model.approxSimilarityJoin(vectors, vectors, radius, "dist").select(F.col("datasetA.id").alias("src"), F.col("datasetB.id").alias("dst"), "dist").where("src <> dst")
    else:
        blocks = max(1, -(-many // BLOCK_ROWS))
        own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        dealt = dealt.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") <= F.col("other")).alias("low"), "id", "v")

        def nearest(group: pd.DataFrame) -> pd.DataFrame:
            one, two = (group[group.low == x] for x in (True, False))
            if group.a.iloc[0] == group.b.iloc[0]:
                two = one
            out = []
            if len(one) and len(two):
                sides = [(np.stack(x.v.to_list()), x.id.to_numpy()) for x in (one, two)]
                out = _nearest(*sides[0], *sides[1], k, metric)
                if two is not one:
                    out += _nearest(*sides[1], *sides[0], k, metric)
            return pd.DataFrame(out, columns=["src", "dst", "dist"]).astype({"src": "int64", "dst": "int64", "dist": "float64"})

        pairs = dealt.groupBy("a", "b").applyInPandas(nearest, "src long, dst long, dist double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def spanning_tree(edges: Iterator[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """A minimum spanning forest of a small graph on the driver."""
    part: dict[int, int] = {}

    def find(x: int) -> int:
        while part.setdefault(x, x) != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    out = []
    for a, b, d in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if find(a) != find(b):
            part[find(a)] = find(b)
            out.append((a, b, d))
    return out


def _layout(nodes: list[int], tree: list[tuple[int, int, float]]) -> dict[int, tuple[float, float]]:
    """Every subtree gets a sector as wide as its leaves are many."""
    near: dict[int, list[int]] = {n: [] for n in nodes}
    for a, b, _ in tree:
        near[a].append(b)
        near[b].append(a)
    out: dict[int, tuple[float, float]] = {}
    for root in nodes:
        if root in out:
            continue
        order, up = [root], {root: None}
        for x in order:
            for y in near[x]:
                if y not in up:
                    up[y] = x
                    order.append(y)
        size = dict.fromkeys(order, 1)
        for x in reversed(order[1:]):
            size[up[x]] += size[x]
        sector, depth = {root: (0.0, 2 * np.pi)}, {root: 0}
        for x in order:
            a, b = sector[x]
            mid = (a + b) / 2
            out[x] = (float(depth[x] * np.cos(mid) + 3 * len(out) ** 0.5 * (x == root)), float(depth[x] * np.sin(mid)))
            for y in near[x]:
                if up.get(y) == x:
                    wide = (b - a) * size[y] / max(1, size[x] - 1)
                    sector[y], depth[y] = (a, a + wide), depth[x] + 1
                    a += wide
    return out


def tree_map(df: DataFrame, path: str, kind: str = "morgan", k: int = 20, metric: str | None = None, properties: list[str] | None = None, cluster_col: str | None = None, **params) -> DataFrame:
    """Writes an HTML map of molecules (smiles) and returns the edges of its tree.

    Ids are those of a column ``id``, or else given.  At most MAP_ROWS molecules, as the driver lays
    them out: take representatives, or a sample, of more.  ``path`` may be on any file system that Spark knows.
    """
    if lost := sorted(set(properties or []) - PROPERTIES.keys()):
        raise ValueError(f"unknown properties: {', '.join(lost)}")
    params = params or ({"fp_size": 2048, "radius": 2} if kind == "morgan" else {})
    spark = df.sparkSession
    if df.limit(MAP_ROWS + 1).count() > MAP_ROWS:
        raise ValueError(f"a map shows at most {MAP_ROWS} molecules; take representatives or a sample")
    rows = featurize(df if "id" in df.columns else df.withColumn("id", F.monotonically_increasing_id()), kind, **params)
    rows = (mol_props(rows, properties) if properties else rows).persist()
    edges = knn_graph(rows, k, metric or ("euclidean" if kind == "mqn" else "jaccard")).select("src", "dst", "dist").collect()
    tree = spanning_tree((r.src, r.dst, r.dist) for r in edges)
    held = rows.drop("fp").collect()
    rows.unpersist()
    at = _layout([r.id for r in held], tree)
    points = [{"x": at[r.id][0], "y": at[r.id][1], "smiles": r.smiles, **{p: r[p] for p in properties or []}, **({"cluster": r[cluster_col]} if cluster_col else {})} for r in held]
    lines = [[*at[a], *at[b]] for a, b, _ in tree]
    write_text(spark, path, _PAGE.replace("POINTS", json.dumps(points)).replace("LINES", json.dumps(lines)))
    return spark.createDataFrame(tree, "src long, dst long, dist double")


def representative_map(df: DataFrame, path: str, kind: str = "mqn", k: int = 21, properties: list[str] | None = None, cluster_col: str = "cluster_id", **params) -> DataFrame:
    """A map of one molecule of each cluster (smiles, cluster id), coloured by cluster: Euclidean for quantum numbers, else Jaccard."""
    return tree_map(df, path, kind, k, None, properties, cluster_col, **params)


_PAGE = """<!doctype html><meta charset="utf-8"><title>Tree map</title><canvas id="c" width="1200" height="900"></canvas><pre id="t"></pre><script>
const points = POINTS, lines = LINES, c = document.getElementById("c"), g = c.getContext("2d");
const xs = points.map(p => p.x), ys = points.map(p => p.y), x0 = Math.min(...xs), x1 = Math.max(...xs), y0 = Math.min(...ys), y1 = Math.max(...ys);
const X = x => 20 + 1160 * (x - x0) / (x1 - x0 || 1), Y = y => 20 + 860 * (y - y0) / (y1 - y0 || 1);
g.strokeStyle = "#bbb"; for (const [a, b, d, e] of lines) { g.beginPath(); g.moveTo(X(a), Y(b)); g.lineTo(X(d), Y(e)); g.stroke(); }
for (const p of points) { g.fillStyle = "cluster" in p ? `hsl(${(p.cluster * 137) % 360} 70% 45%)` : "#246"; g.beginPath(); g.arc(X(p.x), Y(p.y), 4, 0, 7); g.fill(); }
c.onmousemove = e => { const p = points.find(p => Math.hypot(X(p.x) - e.offsetX, Y(p.y) - e.offsetY) < 6); document.getElementById("t").textContent = p ? JSON.stringify(p, null, 1) : ""; };
</script>"""
