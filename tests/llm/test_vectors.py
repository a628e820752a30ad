import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import forest, metric_search
from tessera.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, row int"
ODD = [(9000, None, 1, 0), (9100, [], 1, 0), (9200, [0.0] * 16, 1, 0), (9300, [float("nan")] * 16, 1, 0), (9400, [None] + [1.0] * 15, 1, 0), (9500, [1.0, 2.0], 1, 0), (9600, [float("inf")] * 16, 1, 0)]


def made(seed, n=600, dim=16):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(n // 6, dim))
    v = np.concatenate([centres[rnd.integers(0, len(centres), n // 2)] + rnd.normal(size=(n // 2, dim)) * rnd.choice([0, 0.05, 0.15], (n // 2, 1)), rnd.normal(size=(n - n // 2, dim))])
    v = (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)
    return [(int(i), [float(x) for x in v[k]], int(rnd.integers(0, 3)), 0) for k, i in enumerate(rnd.permutation(n))]


@pytest.mark.parametrize("page", [2000, 40])
def test_top_k(spark, monkeypatch, page):
    monkeypatch.setattr(metric_search, "PAGE_ROWS", page)
    monkeypatch.setattr(metric_search, "NODE_ROWS", 7)
    monkeypatch.setattr(metric_search, "ROUTES", 6)
    rows = [*made(1), *ODD, (None, [1.0] * 16, 1, 0), (50, made(1)[0][1], 2, 0)]
    out = metric_search.top_k(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 20 == 0, Scratch(spark)).collect()
    held = [(k, r[0], np.floor(1024 * np.array(r[1])).astype(int)) for k, r in enumerate(rows) if r[0] is not None and r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all()]
    want = []
    for k, i, q in held:
        if i % 20 == 0:
            best = sorted((-int(q @ x), j) for m, j, x in held if m != k)[:10]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == sorted(want)


def test_scores_beyond_64_bits_are_refused(spark):
    far = spark.createDataFrame([(0, [1.5e6, -1.0e6], 1, 0), (1, [1.25e6, 1.0], 1, 0), (2, [-1.0, 7.0], 1, 0)], "vec_id long, embedding array<double>, label int, row int")
    got = {r.vec_id: r.score for r in metric_search.top_k(far, F.col("vec_id") == 0, Scratch(spark)).collect()}
    assert got == {1: 1024**2 * (1_500_000 * 1_250_000 - 1_000_000), 2: 1024**2 * (-1_500_000 - 7_000_000)}
    with pytest.raises(Exception, match="beyond 64 bits"):
        metric_search.top_k(far.union(spark.createDataFrame([(3, [1e300, 1.0], 1, 0)], far.schema)), F.col("vec_id") == 0, Scratch(spark)).collect()


def test_top_k_small_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 1, 0), (1, [1.0, 1.0], 1, 0), (2, [1.0, 1.0], 1, 0)], SCHEMA)
    got = metric_search.top_k(few, F.col("vec_id") == 0, Scratch(spark)).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 3 * 1024**2), (2, 3 * 1024**2)]
    assert metric_search.top_k(few.limit(0), F.lit(True), Scratch(spark)).count() == 0


def brute(rows):
    unit = []
    for i, v, label, _ in rows:
        ok = v and None not in v and np.isfinite(v).all() and np.any(v) and label is not None
        unit.append(np.array(v, dtype=float) / np.sqrt(np.dot(np.array(v, dtype=float), np.array(v, dtype=float))) if ok else None)
    links = {k: [j for j in range(len(rows)) if j != k and unit[k] is not None and unit[j] is not None and len(unit[k]) == len(unit[j]) and rows[k][2] == rows[j][2] and unit[k] @ unit[j] >= 0.98] for k in range(len(rows))}
    out, seen = {}, set()
    for k in links:
        if k not in seen:
            todo, group = [k], {k}
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            seen |= group
            for j in group:
                out[j] = min((rows[m][0] for m in group if rows[m][0] is not None), default=None)
    return links, out


@pytest.mark.parametrize("leaf,sample", [(2048, 20_000), (30, 100)])
def test_near_duplicates(spark, monkeypatch, leaf, sample):
    """The second case refits leaves, as the first sample carries two cuts, and deals groups in blocks."""
    monkeypatch.setattr(forest, "LEAF_ROWS", leaf)
    monkeypatch.setattr(forest, "AIM_ROWS", 40)
    monkeypatch.setattr(forest, "SAMPLE", sample)
    rows = [*made(2), *ODD, (9501, [1.0, 2.0], 1, 0), (9700, [1.0] * 16, None, 0), (None, [1.0] * 16, 1, 0), (9800, [1.0] * 16, 1, 0), (9800, [1.0] * 16, 1, 0)]
    rows += [(9900 + k, [3.0] + [0.0] * 15, 2, 0) for k in range(50)] + [(9950, [1e30] + [0.0] * 15, 2, 0), (9951, [1e-38] + [0.0] * 15, 2, 0)]
    got = forest.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), Scratch(spark)).collect()
    links, part = brute(rows)
    assert len(got) == len(rows)
    want = sum(map(len, links.values()))
    found = sum(r.n_links for r in got)
    assert 0.97 * want <= found <= want
    by_id = {}
    for k, r in enumerate(rows):
        by_id.setdefault(r[0], []).append((len(links[k]), part[k]))
    assert sum(r.component_id in [p for _, p in by_id[r.vec_id]] for r in got) >= 0.98 * len(got)
    assert all(r.n_links <= max(n for n, _ in by_id[r.vec_id]) and r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_trees_go_on_below_the_first_sample(spark, monkeypatch):
    monkeypatch.setattr(forest, "AIM_ROWS", 20)
    monkeypatch.setattr(forest, "SAMPLE", 100)
    monkeypatch.setattr(forest, "LEAF_SAMPLE", 150)
    scratch, rows = Scratch(spark), made(5, 3000)
    nodes = forest._rows(spark.createDataFrame(rows, SCHEMA).repartition(4), "<f4", "vec_id", "embedding", "label").withColumns({"node": F.col("row"), "copies": F.lit(1).cast("long")})
    trees, sizes = forest.fitted(scratch.write(nodes, "n"), 16, "<f4", scratch)
    assert min(int(t.places.max()).bit_length() for t in trees) >= 6  # the first sample carries two
    held = sizes.groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    assert np.median([r.n for r in held]) <= 40


def test_near_duplicates_of_nothing(spark):
    assert forest.near_duplicates(spark.createDataFrame([], SCHEMA), Scratch(spark)).count() == 0
