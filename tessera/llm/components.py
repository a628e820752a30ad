"""Connected components by alternating large-star and small-star steps on a DataFrame of links.

Each step is a minimum per node (combined before the shuffle) and a join back, so no task gathers a
node's neighbours; a hub's rows of the join are split by AQE.  Each round is written to the
shared folder, which cuts the lineage.  Rounds grow with the logarithm of a component's diameter.
At most FEW_LINKS links, 16 bytes each, are united in one task instead of in many jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Links that one task may unite; more are united in rounds.
FEW_LINKS = 100_000


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """u > v: u and its smaller neighbours are linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _in_one_task(links: DataFrame) -> DataFrame:
    """(node, component) of few links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns)):
                u, v = top(u), top(v)
                up[max(u, v)] = min(u, v)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array(map(top, nodes), type=pa.int64())], names=["node", "component"])

    return links.coalesce(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame, a: str, b: str, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the least node reachable, for every node that has a link to another."""
    start = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, before, turn = scratch.write(start, f"{name}-0"), None, 0
    if now.count() <= FEW_LINKS:
        return scratch.write(_in_one_task(now), f"{name}-few")
    while True:
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == before or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before, turn = seen, turn + 1
        now = scratch.write(_small(_large(now)), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
