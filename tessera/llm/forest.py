"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors of one label are one node, which knows how many copies it stands for.  Each tree
splits recursively at the sample's median along a random direction, the one of DIRECTIONS whose band
of SPILL around the median holds least; vectors in the band go both ways, so close vectors seldom
part in all TREES trees.  A band of more than MOST_SHARE of the sample is not split, so copies of rows are
bounded where vectors lie close together.  Every table is split, LEAST_DEPTH times at least.

Depth follows the table: trees start from one bounded sample; leaves that turn out to hold more than
twice AIM_ROWS rows are fitted anew, each on a bounded sample of its own rows, in tasks, until none is left that
splits.  Directions follow from seeds, so a tree is a list of cuts of 17 bytes, at most MOST_CUTS; only beyond
that, or where a leaf does not split, leaves grow.  Nodes of one leaf and label are compared
with one another, a leaf of over LEAF_ROWS in pairs of blocks, all of them.  A pair that meets in
several leaves counts in the first one, by the earlier leaves that both carry.  Only counts and a spanning
forest of each leaf's links go on, never its pairs.

Recall of the links against brute force is measured in the tests, also with refitted leaves; the
README has figures at 50,000 rows.  Vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing; vectors of another length than most are compared among their
like.  Repeated rows are vectors of their own and link.  A null vec_id never names a component that
has another id.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tessera.llm.common import Scratch, table, text_batches
from tessera.llm.components import components

LEAST = 0.98
TREES, SPILL, DIRECTIONS = 4, 0.01, 4
MOST_SHARE, LEAST_DEPTH = 0.3, 2
#: Rows of a leaf that the depth aims at, over all labels, and rows above which one label's leaf is dealt in blocks.
AIM_ROWS, LEAF_ROWS = 1024, 512
#: Rows of the first sample, of a leaf's own, and those that a split needs.
SAMPLE, LEAF_SAMPLE, LEAST_SAMPLE = 20_000, 4096, 16
#: Cuts of a tree at most, for its size as a broadcast; leaves that may be fitted in one round.
MOST_CUTS, ROUND_LEAVES = 1 << 20, 100_000
#: Bits of a leaf's place in its tree.
PLACE = 56
#: Rows up to which a list of groups is broadcast (24 bytes each).
BROADCAST_ROWS = 200_000


def _unit_of(raw: bytes, kind: str) -> np.ndarray | None:
    """The unit vector in float64; None if the components are not finite or all zero."""
    x = np.frombuffer(raw, dtype=kind).astype(np.float64)
    size = np.sqrt(x @ x) if np.isfinite(x).all() else 0.0
    if (size == 0 or not np.isfinite(size)) and np.isfinite(x).all() and x.any():
        x = x / np.abs(x).max()  # its squares are out of range
        size = np.sqrt(x @ x)
    return x / size if size > 0 else None


def _rows(df: DataFrame, kind: str, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, vec_id, label, dim, one, two, vec): vec has the components as they are, null if it can't link; one and two are its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys, out = [], [], []
            for v, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = np.array(v, dtype=kind).tobytes() if v and None not in v and label is not None else None
                if raw is None or _unit_of(raw, kind) is None:
                    raw, v = None, ()
                digest = hashlib.blake2b(raw or b"", digest_size=16).digest()
                keys.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
                dims.append(len(v))
                out.append(raw)
            digests = [pa.array([k[n] for k in keys], type=pa.int64()) for n in (0, 1)]
            columns = [batch.column(0), batch.column(2), pa.array(dims, type=pa.int32()), *digests, pa.array(out, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "dim", "one", "two", "vec"])

    df = df.select(F.col(id_col).cast("long").alias("vec_id"), vector_col, F.col(label_col).cast("long").alias("label"))
    return df.mapInArrow(run, "vec_id long, label long, dim int, one long, two long, vec binary").withColumn("row", F.monotonically_increasing_id())


@lru_cache(maxsize=20_000)
def direction(tree: int, place: int, choice: int, dim: int) -> np.ndarray:
    """A random unit vector that follows from its place alone."""
    x = np.random.default_rng([tree, place, choice]).normal(size=dim)
    return x / np.sqrt(x @ x)


Cut = tuple[int, int, float]  # place (the root is 1, the parts of p are 2 p and 2 p + 1), choice of direction, cut


def grow(sample: np.ndarray, tree: int, place: int, rows: float, aim: int, depth: int = 0) -> list[Cut]:
    """Cuts below ``place`` by a sample that stands for ``rows`` rows, down to ``aim`` rows; ``depth`` cuts are made for any number."""
    if len(sample) < 2 * LEAST_SAMPLE or rows <= aim and depth <= 0 or place >= 1 << (PLACE - 2):
        return []
    best = None
    for choice in range(DIRECTIONS):
        x = sample @ direction(tree, place, choice, sample.shape[1])
        cut = float(np.median(x))
        share = float((np.abs(x - cut) <= SPILL).mean())
        if best is None or share < best[0]:
            best = (share, choice, cut, x)
    share, choice, cut, x = best
    low = x <= cut
    if share > MOST_SHARE or not 0 < low.sum() < len(x):
        return []
    out = [(place, choice, cut)]
    for part, mine in ((2 * place, low), (2 * place + 1, ~low)):
        out += grow(sample[mine], tree, part, rows * mine.mean(), aim, depth - 1)
    return out


class Tree:
    """Cuts in order of their places."""

    def __init__(self, number: int, cuts: list[Cut]):
        self.number = number
        cuts = sorted(cuts)[:MOST_CUTS]  # by place, so by depth: a part never stays without its whole
        self.places = np.array([c[0] for c in cuts], dtype=np.int64)
        self.choices = np.array([c[1] for c in cuts], dtype=np.int8)
        self.cuts = np.array([c[2] for c in cuts])

    def with_more(self, cuts: list[Cut]) -> Tree:
        return Tree(self.number, [*zip(self.places.tolist(), self.choices.tolist(), self.cuts.tolist()), *cuts])

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector number, leaf) pairs; a vector near a cut is in several leaves."""
        out, todo = [], [(1, np.arange(len(vectors)))]
        while todo:
            place, mine = todo.pop()
            if not len(mine):
                continue
            at = int(np.searchsorted(self.places, place))
            if at == len(self.places) or self.places[at] != place:
                out.append((mine, np.full(len(mine), (self.number << PLACE) + place)))
                continue
            x = vectors[mine] @ direction(self.number, place, int(self.choices[at]), vectors.shape[1])
            cut = self.cuts[at]
            todo += [(2 * place, mine[x <= cut + SPILL]), (2 * place + 1, mine[x > cut - SPILL])]
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _leaves_of(batch: pa.RecordBatch, trees: list[Tree], dim: int, kind: str) -> list[np.ndarray]:
    """The leaves of each node of the batch in order; those of another dimension have one of their own."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    out = [np.array([-d], dtype=np.int64) for d in dims.tolist()]
    usual = np.flatnonzero(dims == dim)
    if len(usual):
        data = batch.column("vec").to_pylist()
        v = np.stack([_unit_of(data[k], kind) for k in usual])
        who, leaf = (np.concatenate(c) for c in zip(*(t.leaves(v) for t in trees)))
        order = np.lexsort((leaf, who))
        who, leaf = who[order], leaf[order]
        for k, own in zip(usual.tolist(), np.split(leaf, np.searchsorted(who, np.arange(1, len(usual))))):
            out[k] = own
    return out


def _sizes(nodes: DataFrame, trees, dim: int, kind: str) -> DataFrame:
    """(leaf, label, n), combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = _leaves_of(batch, trees.value, dim, kind)
            if not leaves:
                continue
            label = np.repeat(batch.column("label").to_numpy(zero_copy_only=False), [len(x) for x in leaves])
            leaf = np.concatenate(leaves)
            pairs, n = np.unique(np.stack([leaf, label]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n)], names=["leaf", "label", "n"])

    return nodes.select("label", "dim", "vec").mapInArrow(run, "leaf long, label long, n long").groupBy("leaf", "label").agg(F.sum("n").alias("n"))


def _refitted(nodes: DataFrame, trees, dim: int, kind: str, large: dict[int, int]) -> dict[int, list[Cut]]:
    """Cuts below each of the leaves of ``large`` (leaf to rows), fitted in tasks on samples of its rows."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rnd = np.random.default_rng(0)
        for batch in batches:
            leaf, vec = [], []
            data = batch.column("vec").to_pylist()
            for k, own in enumerate(_leaves_of(batch, trees.value, dim, kind)):
                for x in own.tolist():
                    if x in large and rnd.random() * large[x] < LEAF_SAMPLE:
                        leaf.append(x)
                        vec.append(data[k])
            yield pa.RecordBatch.from_arrays([pa.array(leaf, type=pa.int64()), pa.array(vec, type=pa.binary())], names=["leaf", "vec"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def done() -> None:
            if held:
                sample = np.stack([_unit_of(v, kind) for v in held])
                out.extend((now, *c) for c in grow(sample, now >> PLACE, now & ((1 << PLACE) - 1), large[now], AIM_ROWS))

        for batch in batches:
            for leaf, vec in zip(*(c.to_pylist() for c in batch.columns)):
                if leaf != now:
                    done()
                    now, held = leaf, []
                held.append(vec)
        done()
        columns = list(zip(*out)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["leaf", "place", "choice", "cut"])

    drawn = nodes.select("label", "dim", "vec").mapInArrow(draw, "leaf long, vec binary")
    found: dict[int, list[Cut]] = {}
    for r in drawn.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(fit, "leaf long, place long, choice int, cut double").collect():
        found.setdefault(r.leaf, []).append((r.place, r.choice, r.cut))
    return found


def fitted(nodes: DataFrame, dim: int, kind: str, scratch: Scratch) -> tuple[list[Tree], DataFrame]:
    """The trees, and the stored sizes of their leaves."""
    context = nodes.sparkSession.sparkContext
    usual = nodes.where(F.col("dim") == dim)
    many = usual.count()
    picked = usual.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vec").collect()
    sample = np.stack([_unit_of(r.vec, kind) for r in picked])
    trees = [Tree(t, grow(sample, t, 1, many, AIM_ROWS, LEAST_DEPTH)) for t in range(TREES)]
    tried: set[int] = set()
    for turn in range(PLACE):
        shared = context.broadcast(trees)
        sizes = scratch.write(_sizes(nodes, shared, dim, kind), f"sizes-{turn}")
        large = sizes.where("leaf > 0").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * AIM_ROWS)
        large = {r.leaf: r.n for r in large.orderBy(F.desc("n"), "leaf").limit(ROUND_LEAVES).collect() if r.leaf not in tried}
        large = {x: n for x, n in large.items() if len(trees[x >> PLACE].places) < MOST_CUTS}
        more = _refitted(nodes, shared, dim, kind, large) if large else {}
        shared.unpersist()
        if not more:
            break
        tried.update(x for x in large if x not in more)  # these don't split
        trees = [t.with_more([c for x, cuts in more.items() if x >> PLACE == t.number for c in cuts]) for t in trees]
    return trees, sizes


def _routed(nodes: DataFrame, trees, dim: int, kind: str) -> DataFrame:
    """A row per node and leaf, with the node's earlier leaves as little-endian int64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = _leaves_of(batch, trees.value, dim, kind)
            if not leaves:
                continue
            at = pa.array(np.repeat(np.arange(len(leaves)), [len(x) for x in leaves]))
            names = ["node", "label", "copies", "vec"]
            earlier = [x[:k].astype("<i8").tobytes() for x in leaves for k in range(len(x))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(np.concatenate(leaves)), pa.array(earlier, type=pa.binary())], names=[*names, "leaf", "earlier"])

    return nodes.select("node", "label", "copies", "dim", "vec").mapInArrow(run, "node long, label long, copies long, vec binary, leaf long, earlier binary")


def _linked(v: np.ndarray, nodes: np.ndarray, copies: np.ndarray, sides: np.ndarray, across: bool, earlier: list[bytes], least: float) -> list[tuple[int, int, int]]:
    """(node, links counted here, least node reached by links here) of one group; ``across``, only pairs of both sides."""
    near = v @ v.T >= least
    np.fill_diagonal(near, False)
    if across:
        near &= sides[:, None] != sides[None, :]
    busy = np.flatnonzero(near.any(axis=1))
    if not len(busy):
        return []
    near, nodes, copies = near[np.ix_(busy, busy)], nodes[busy], copies[busy]
    own = [np.frombuffer(earlier[k], dtype="<i8") for k in busy]
    who, leaf = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
    order = np.argsort(leaf, kind="stable")
    who, leaf = who[order], leaf[order]
    met = np.zeros(near.shape, dtype=bool)  # pairs that an earlier leaf has counted
    cuts = np.flatnonzero(np.diff(leaf)) + 1
    for members in np.split(who, cuts):
        if len(members) > 1:
            met[np.ix_(members, members)] = True
    links = (near & ~met) @ copies
    order = np.argsort(nodes)
    part = np.empty(len(nodes), dtype=np.int64)
    part[order] = np.arange(len(nodes))
    while True:  # the least rank among neighbours, then among theirs
        best = np.minimum(part, np.where(near, part[None, :], len(nodes)).min(axis=1))
        best = np.minimum(best, best[order[best]])
        if (best == part).all():
            break
        part = best
    return list(zip(nodes.tolist(), links.tolist(), nodes[order][part].tolist()))


def _compared(routed: DataFrame, sizes: DataFrame, kind: str, least: float) -> DataFrame:
    """(node, links, root) from every leaf."""
    hot = sizes.where(F.col("n") > LEAF_ROWS).select("leaf", "label", F.ceil(F.col("n") * 2 / LEAF_ROWS).cast("int").alias("blocks"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    rows = routed.join(hot, ["leaf", "label"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.lit(0)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    group = ["leaf", "label", "first", "second"]
    rows = rows.select("leaf", "label", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), (F.col("block") > F.col("other")).alias("side"), "node", "copies", "vec", "earlier")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            sides, nodes, copies, vecs, earlier = zip(*held)
            found = []
            if len(held) > 1:
                v = np.stack([_unit_of(x, kind) for x in vecs])
                found = _linked(v, np.array(nodes), np.array(copies), np.array(sides), now[2] != now[3], earlier, least)
            columns = list(zip(*found)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["node", "links", "root"])

        for batch in batches:
            for *key, side, node, copies, vec, earlier in zip(*(batch.column(c).to_pylist() for c in (*group, "side", "node", "copies", "vec", "earlier"))):
                if key != now and held:
                    yield done()
                    held = []
                now = key
                held.append((side, node, copies, vec, earlier))
        if held:
            yield done()

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "node long, links long, root long")


def near_duplicates(df: DataFrame, scratch: Scratch, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept."""
    context = df.sparkSession.sparkContext
    kind = "<f4" if isinstance(df.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    rows = scratch.write(_rows(df, kind, id_col, vector_col, label_col), "vectors")
    key = ["label", "dim", "one", "two"]
    nodes = rows.where("dim > 0").groupBy(*key).agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("vec").alias("vec"))
    nodes = scratch.write(nodes, "nodes")
    usual = nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    own = F.col("vec_id").alias("component_id")
    if usual is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), own, F.lit(True).alias("kept"))
    trees, sizes = fitted(nodes, usual.dim, kind, scratch)
    shared = context.broadcast(trees)
    found = scratch.write(_compared(_routed(nodes, shared, usual.dim, kind), sizes, kind, least), "found")
    shared.unpersist()
    part = components(found, "node", "root", scratch, "parts").select("node", F.col("component").alias("part"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select(*key, "node", "copies", "first").join(links, "node", "left").join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    names = named.groupBy("part").agg(F.min("first").alias("component_id"))
    named = named.join(names, "part").select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", *key).join(named, key, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark, 1000)
    return near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark))


#: DuckDB SQL for the query: every pair of a label, and the closure of its links.
ORACLE = f"""
    WITH RECURSIVE held AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM held a JOIN held b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {LEAST}),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    parts AS (SELECT a, min(b) AS least FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(p.least, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(p.least, e.vec_id)) AS kept
    FROM embeddings e LEFT JOIN parts p ON e.vec_id = p.a LEFT JOIN counts c ON e.vec_id = c.a"""
