"""Exact top-k inner products by best-first search of M-trees.

Vectors are made integers, x -> floor(SCALE * x).  With one more coordinate, sqrt(M - |x|^2) for
rows (M the greatest squared norm) and 0 for queries, the squared Euclidean distance is
|q|^2 + M - 2 q.x, so nearest is highest, and scores stay exact integers.

Index: a tree of metric nodes.  Its upper two levels are routing vectors, at most PIVOTS and below
them about one for PAGE_ROWS rows, ROUTES in all, drawn by hash order; a row belongs to the nearest of the
first and then to the nearest of that one's.  Each has its covering radius, least distance and distance to its parent.  Rows of a
route are its page (several, by hash, only where it holds far more than PAGE_ROWS rows), and a page
has routing nodes with a vector, radius and parent distance above its entries with theirs, stored as plain columns,
a row per node.  Every row is indexed.

Search: a query first visits the nearest page that can fill its k places, which bounds its k-th
score; then every page that may reach that bound, by the upper levels' radii, where stored parent
distances spare the distances to most routes.  In a page the nodes are visited in order of the least
distance they allow, until that is beyond the k-th score found; triangle inequalities on stored parent
distances skip nodes and entries before any distance is computed.  Queries meet pages in blocks of QUERY_BLOCK.

Rows without vec_id, and vectors null or with null or non-finite components take no part, nor do
vectors of another length than most.  Scores must fit a long: a vector whose integer components'
squares sum to 2**62 or more is refused with an error.  Equal scores go to the smaller vec_id; repeated rows are rows of their own.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table, text_batches

SCALE = 1024
#: Routing vectors of the first level at most, those of the second, and rows of a page that they aim at.
PIVOTS, ROUTES, PAGE_ROWS = 256, 32_000, 1000
#: Entries of a page's node.
NODE_ROWS = 50
QUERY_BLOCK = 5000
#: Distances are floats; bounds are widened by this share.
SLACK = 1e-9
#: Squared norms from which a score might not fit a long.
NORM = 1 << 62


def integer_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, dim, norm, vec) of the rows that take part; vec has little-endian int64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, dtype=np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        x = np.floor(scale * x)
                        norm = float(x @ x)
                    if not norm < NORM * (1 - 1e-9):
                        raise ValueError(f"{id_col} {i}: components of this size give scores beyond 64 bits")
                    x = x.astype("<i8")
                    rows.append((i, len(x), int(x @ x), x.tobytes()))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["vec_id", "dim", "norm", "vec"])

    return df.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "vec_id long, dim int, norm long, vec binary").withColumn("row", F.monotonically_increasing_id())


def _last(vectors: np.ndarray, top: int) -> np.ndarray:
    """The added coordinate of rows."""
    return np.sqrt((top - (vectors * vectors).sum(axis=-1)).astype(np.float64))


def _distances(vectors: np.ndarray, last: np.ndarray, v: np.ndarray, own: float) -> np.ndarray:
    apart = (vectors - v).astype(np.float64)
    return np.sqrt((apart * apart).sum(axis=-1) + (last - own) ** 2)


def _reach(size: int, top: int, score: int) -> float:
    """The distance at which a row has this score for a query of squared norm ``size``."""
    return float(np.sqrt(max(0, size + top - 2 * score))) * (1 + SLACK) + SLACK


Node = tuple[np.ndarray, float, float, float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def page_nodes(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, route: np.ndarray, top: int) -> list[Node]:
    """Of a page below the vector ``route``: (vector, last, distance to route, radius, entries, their distances in order, ids, rows)."""
    last, out = _last(vectors, top), []
    to_route = _distances(vectors, last, route, float(_last(route, top)))
    many = max(1, -(-len(vectors) // NODE_ROWS))
    pick = np.argsort(to_route, kind="stable")[np.linspace(0, len(vectors) - 1, many).astype(int)]
    apart = np.stack([_distances(vectors, last, vectors[p], last[p]) for p in pick], axis=1)
    own = apart.argmin(axis=1)
    for k, p in enumerate(pick):
        mine = np.flatnonzero(own == k)
        if len(mine):
            order = mine[np.argsort(apart[mine, k])]
            d = apart[order, k]
            out.append((vectors[p], float(last[p]), float(to_route[p]), float(d[-1]), vectors[order], d, ids[order], rows[order]))
    return out


class Page:
    """The nodes of a page below the vector ``route``, their vectors side by side."""

    def __init__(self, nodes: list[Node], route: np.ndarray, top: int):
        self.nodes, self.route, self.top = nodes, route, top
        self.vectors, self.last = np.stack([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        self.parent, self.radius = np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes])
        self.route_last = float(_last(route, top))

    def search(self, query: np.ndarray, own_row: int, k: int, least: int | None) -> list[tuple[int, int]]:
        """The k best (score, vec_id) of the page but the query's own row, of score ``least`` and more."""
        size = int(query @ query)
        best: list[tuple[int, int]] = []  # a heap of (score, -vec_id): the worst of the best on top
        reach = np.inf if least is None else _reach(size, self.top, least)
        gap = np.abs(float(_distances(query, 0.0, self.route, self.route_last)) - self.parent) - self.radius
        near = np.flatnonzero(gap <= reach)  # the others go without a distance
        to_node = _distances(self.vectors[near], self.last[near], query, 0.0)
        low = np.maximum(np.maximum(gap[near], to_node - self.radius[near]), 0.0)
        for n in np.argsort(low, kind="stable").tolist():
            if low[n] > reach:
                break
            members, parent, ids, rows = self.nodes[near[n]][4:]
            a, b = np.searchsorted(parent, to_node[n] - reach - SLACK), np.searchsorted(parent, to_node[n] + reach + SLACK, side="right")
            scores = members[a:b] @ query
            wanted = least if len(best) < k else best[0][0]
            some = np.flatnonzero(scores >= wanted) if wanted is not None else range(b - a)
            for m in some:
                score, i = int(scores[m]), int(ids[a + m])
                if rows[a + m] == own_row:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
            if len(best) == k:
                reach = min(reach, _reach(size, self.top, best[0][0]))
        return [(score, -i) for score, i in best]


class Routes:
    """The upper two levels: first vectors, and second ones in the order of their first."""

    def __init__(self, firsts: np.ndarray, seconds: np.ndarray, of: np.ndarray, top: int):
        self.firsts, self.seconds, self.of, self.top = firsts, seconds, of, top
        self.first_last, self.second_last = _last(firsts, top), _last(seconds, top)
        self.starts = np.searchsorted(of, np.arange(len(firsts) + 1))
        self.to_parent = np.array([_distances(seconds[n], self.second_last[n], firsts[f], self.first_last[f]) for n, f in enumerate(of.tolist())])
        zero = np.zeros(len(seconds))
        self.radius, self.inner, self.held, self.pages = zero, zero.copy(), zero.astype(np.int64), zero.astype(np.int64)

    def measure(self, found: dict[int, tuple[int, float, float]]) -> None:
        """Takes (rows, least and greatest distance) of each second vector."""
        for n, (held, low, high) in found.items():
            self.held[n], self.inner[n], self.radius[n] = held, low, high
        self.pages = np.where(self.held > PAGE_ROWS + PAGE_ROWS // 4, -(-self.held // PAGE_ROWS), (self.held > 0).astype(np.int64))
        self.before = np.cumsum(self.pages) - self.pages
        some = self.held > 0
        reach = np.where(some, self.to_parent + self.radius, 0.0)
        self.cover = np.array([reach[a:b].max(initial=0.0) for a, b in zip(self.starts, self.starts[1:])])

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row its second vector, and the distance to it."""
        last = _last(v, self.top)
        first = np.stack([_distances(v, last, p, q) for p, q in zip(self.firsts, self.first_last)], axis=1).argmin(axis=1)
        route, apart = np.empty(len(v), dtype=np.int64), np.empty(len(v))
        for f in np.unique(first).tolist():
            mine, below = np.flatnonzero(first == f), range(self.starts[f], self.starts[f + 1])
            d = np.stack([_distances(v[mine], last[mine], self.seconds[n], self.second_last[n]) for n in below], axis=1)
            route[mine], apart[mine] = d.argmin(axis=1) + self.starts[f], d.min(axis=1)
        return route, apart

    def visits(self, query: np.ndarray, least: int | None, k: int) -> list[int]:
        """Routes to visit: at first the nearest ones that hold k others; with a bound, all that may reach it."""
        to_first = _distances(self.firsts, self.first_last, query, 0.0)
        if least is None:
            out, held = [], 0
            for f in np.argsort(to_first).tolist():
                below = np.arange(self.starts[f], self.starts[f + 1])
                below = below[self.held[below] > 0]
                for n in below[np.argsort(_distances(self.seconds[below], self.second_last[below], query, 0.0))].tolist():
                    out.append(n)
                    held += self.held[n] // self.pages[n]
                    if held > k:
                        return out
            return out
        reach = _reach(int(query @ query), self.top, least)
        near = np.concatenate([np.arange(self.starts[f], self.starts[f + 1]) for f in np.flatnonzero(to_first - self.cover <= reach)] or [np.zeros(0, dtype=np.int64)])
        near = near[self.held[near] > 0]
        near = near[np.abs(to_first[self.of[near]] - self.to_parent[near]) - self.radius[near] <= reach]
        apart = _distances(self.seconds[near], self.second_last[near], query, 0.0)
        return near[np.maximum(apart - self.radius[near], self.inner[near] - apart) <= reach].tolist()


NODE = "page long, route binary, vector binary, last double, parent double, radius double, entries binary, apart binary, ids binary, rows binary"
NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]


def _visit(nodes: DataFrame, visits: DataFrame, top: int, k: int) -> DataFrame:
    """(row, query_id, vec_id, score) of every visit of a query to a page."""
    blocks = visits.select("page", "block").distinct()
    asked = visits.select("page", "block", F.lit(1).alias("kind"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in NODE.split(", ")[1:]], "row", "vec_id", "least", "vec")
    held = nodes.join(blocks, "page").select("page", "block", F.lit(0).alias("kind"), *NODE_NAMES[1:], *[F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("vec_id", "long"), ("least", "long"), ("vec", "binary"))])
    whole = lambda x: np.frombuffer(x, dtype="<i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, page = None, [], None
        names = ["page", "block", "kind", *NODE_NAMES[1:], "row", "vec_id", "least", "vec"]
        for batch in batches:
            found = []
            for p, block, kind, route, vector, last, parent, radius, entries, apart, ids, rows, row, vec_id, least, vec in zip(*(batch.column(c).to_pylist() for c in names)):
                if (p, block) != at:
                    at, nodes, page = (p, block), [], None
                if kind == 0:
                    v, center = whole(vector), whole(route)
                    nodes.append((v, last, parent, radius, whole(entries).reshape(-1, len(v)), np.frombuffer(apart, dtype="<f8"), whole(ids), whole(rows)))
                elif nodes:
                    page = page or Page(nodes, center, top)
                    found += [(row, vec_id, i, score) for score, i in page.search(whole(vec), row, k, least)]
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["row", "query_id", "vec_id", "score"])

    return held.union(asked).repartition("page", "block").sortWithinPartitions("page", "block", "kind").mapInArrow(run, "row long, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _drawn(every: DataFrame, total: int, top: int, scratch: Scratch) -> Routes:
    """Routing vectors of both levels: rows in hash order, so at most ROUTES come to the driver."""
    wanted = min(ROUTES, -(-total // PAGE_ROWS))
    picked = every.orderBy(F.xxhash64("row"), "row").limit(wanted).select("vec").collect()
    seconds = np.unique(np.stack([np.frombuffer(r.vec, dtype="<i8") for r in picked]), axis=0)
    many = min(PIVOTS, int(np.ceil(np.sqrt(len(seconds)))))
    firsts = seconds[np.random.default_rng(0).choice(len(seconds), many, replace=False)]
    last, first_last = _last(seconds, top), _last(firsts, top)
    of = np.stack([_distances(seconds, last, p, q) for p, q in zip(firsts, first_last)], axis=1).argmin(axis=1)
    order = np.argsort(of, kind="stable")
    return Routes(firsts, seconds[order], of[order], top)


def top_k(df: DataFrame, queries: F.Column, scratch: Scratch, k: int = 10, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where ``queries`` (over vec_id) holds, the k best other rows."""
    spark = df.sparkSession
    every = scratch.write(integer_vectors(df, scale, id_col, vector_col), "vectors")
    usual = every.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top")).orderBy(F.desc("n"), "dim").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every, top = every.where(F.col("dim") == usual.dim), usual.top
    routes = _drawn(every, usual.n, top, scratch)
    shared = spark.sparkContext.broadcast(routes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.frombuffer(b"".join(batch.column("vec").to_pylist()), dtype="<i8").reshape(batch.num_rows, -1)
                route, apart = shared.value.nearest(v)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "vec")), pa.array(route), pa.array(apart)], names=["row", "vec_id", "vec", "route", "apart"])

    assigned = scratch.write(every.select("row", "vec_id", "vec").mapInArrow(assign, "row long, vec_id long, vec binary, route long, apart double"), "assigned")
    sizes = assigned.groupBy("route").agg(F.count("*").alias("n"), F.min("apart").alias("low"), F.max("apart").alias("high")).collect()  # at most ROUTES
    routes.measure({r.route: (r.n, r.low, r.high) for r in sizes})
    shared.unpersist()
    shared = spark.sparkContext.broadcast(routes)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, route = shared.value, batch.column("route").to_numpy(zero_copy_only=False)
            page = r.before[route] + batch.column("hash").to_numpy(zero_copy_only=False) % r.pages[route]
            yield pa.RecordBatch.from_arrays([pa.array(page), *(batch.column(c) for c in ("route", "row", "vec_id", "vec"))], names=["page", "route", "row", "vec_id", "vec"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, rows = None, []
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

        def done() -> pa.RecordBatch:
            route = shared.value.seconds[rows[0][0]]
            found = page_nodes(np.stack([np.frombuffer(r[3], dtype="<i8") for r in rows]), np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), route, top)
            out = [(page, route.tobytes(), v.tobytes(), last, parent, radius, *(x.tobytes() for x in more)) for v, last, parent, radius, *more in found]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=NODE_NAMES)

        for batch in batches:
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("page", "route", "row", "vec_id", "vec"))):
                if p != page and rows:
                    yield done()
                    rows = []
                page = p
                rows.append(row)
        if rows:
            yield done()

    hashed = assigned.select("route", "row", "vec_id", "vec", F.pmod(F.xxhash64("row"), F.lit(1 << 40)).alias("hash"))
    paged = hashed.mapInArrow(numbered, "page long, route long, row long, vec_id long, vec binary")
    nodes = scratch.write(paged.repartition("page").sortWithinPartitions("page", "row").mapInArrow(build, NODE), "nodes")
    asked = assigned.where(queries).select("row", "vec_id", "vec")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            out = []
            for row, i, v, least in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "vec", "least"))):
                found = r.visits(np.frombuffer(v, dtype="<i8"), least, k)
                for n in found:
                    many = int(r.pages[n]) if least is not None or len(found) > 1 else 1
                    out += [(int(r.before[n]) + p, row, i, v, least) for p in range(many)]
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["page", "row", "vec_id", "vec", "least"])

    def routed(some: DataFrame) -> DataFrame:
        return some.mapInArrow(route, "page long, row long, vec_id long, vec binary, least long").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    nearest = routed(asked.withColumn("least", F.lit(None).cast("long")))
    bound = scratch.write(_best(_visit(nodes, nearest, top, k), k).where(F.col("rank") == k).select("row", F.col("score").alias("least")), "bound")
    bounded = asked.join(bound, "row", "left").withColumn("least", F.coalesce("least", F.lit(-NORM)))  # fewer than k others: all pages
    return _best(_visit(nodes, routed(bounded), top, k), k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark, 1000)
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, Scratch(spark))


#: DuckDB SQL for the query: every pair of a query and a row.
ORACLE = """
    WITH held AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.r, q.vec_id AS query_id, x.vec_id, list_dot_product(q.v::DOUBLE[], x.v::DOUBLE[])::BIGINT AS score FROM held q, held x WHERE q.vec_id % 100 = 0 AND q.r <> x.r),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10"""
