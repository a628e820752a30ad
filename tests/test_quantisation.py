import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.operators.pq import PQEncoder, PQModel, auto_m, code_type, nearest
from tessera.operators.pqkmeans import PQKMeans, PQKMeansModel, closest, code_histogram, updated_centers


def vectors(spark, n=300, dim=12, seed=0):
    x = np.random.default_rng(seed).integers(0, 50, (n, dim))
    return spark.createDataFrame([(i, [int(v) for v in row]) for i, row in enumerate(x)], "id long, fp array<int>").repartition(3), x


def test_encoder(spark, tmp_path):
    df, x = vectors(spark)
    model = PQEncoder(k=8, m=4, iterations=3).fit(df)
    codes = np.array([r.codes for r in model.encode(df).orderBy("id").collect()])
    assert (codes == nearest(x.astype(float), model.codewords)).all()
    raw = model.decode(model.encode(df), round=False)
    again = np.array([r.codes for r in model.encode(raw.drop("codes"), "decoded").orderBy("id").collect()])
    want = np.concatenate([model.codewords[s][codes[:, s]] for s in range(4)], axis=1)
    assert np.allclose(np.concatenate([model.codewords[s][again[:, s]] for s in range(4)], axis=1), want)
    errors = [((x - np.concatenate([w[s][nearest(x.astype(float), w)[:, s]] for s in range(4)], axis=1)) ** 2).sum() for w in (PQEncoder(8, 4, i).fit(df).codewords for i in (0, 1, 3))]
    assert errors[0] >= errors[1] >= errors[2]
    model.save(spark, str(tmp_path / "pq"))
    assert np.array_equal(PQModel.load(spark, str(tmp_path / "pq")).codewords, model.codewords)
    t = model.distance_tables()
    assert np.allclose(t, t.transpose(0, 2, 1)) and np.allclose(np.einsum("saa->sa", t), 0)


def test_encoder_refuses(spark):
    df, _ = vectors(spark, n=8)
    with pytest.raises(AssertionError):
        PQEncoder(k=8, m=4).fit(df)
    with pytest.raises(AssertionError):
        PQEncoder(k=4, m=5).fit(df)
    encoder = PQEncoder(k=4, m=4, iterations=1)
    encoder.fit(df)
    with pytest.raises(AssertionError):
        encoder.fit(df)
    assert (auto_m(42), auto_m(1024), auto_m(30), code_type(256), code_type(257)) == (6, 8, 6, "smallint", "int")
    with pytest.raises(ValueError):
        auto_m(7)


def test_center_update(spark):
    """Random codes and tables: of each cluster and subspace the codeword of least total distance, by brute force."""
    rnd = np.random.default_rng(11)
    tables = rnd.integers(0, 40, (3, 7, 7)).astype(float)
    codes, labels = rnd.integers(0, 7, (90, 3)), rnd.choice([0, 1, 3, 4], 90)
    previous = rnd.integers(0, 7, (6, 3))
    labelled = spark.createDataFrame([(c.tolist(), int(k)) for c, k in zip(codes, labels)], "codes array<int>, cluster_id int").repartition(3)
    want = previous.copy()
    for k in range(6):
        for s in range(3):
            cost = [sum(tables[s][c, w] for c in codes[labels == k, s]) for w in range(7)]
            want[k, s] = cost.index(min(cost)) if (labels == k).any() else previous[k, s]
    new = updated_centers(code_histogram(labelled), tables, previous)
    assert new.tolist() == want.tolist() and new[2].tolist() == previous[2].tolist()


def test_clustering(spark, tmp_path):
    df, _ = vectors(spark)
    pq = PQEncoder(k=8, m=4, iterations=2).fit(df)
    codes = pq.encode(df)
    model = PQKMeans(pq, 10, iterations=6).fit(codes)
    labelled = model.assign(codes, with_distance=True)
    again = PQKMeans(pq, 10, iterations=6, dedupe=True).fit(codes.repartition(5))
    assert np.array_equal(again.centers, model.centers)
    rows = labelled.orderBy("id").collect()
    label, d = closest(np.array([r.codes for r in rows]), model.centers, pq.distance_tables())
    assert [r.cluster_id for r in rows] == label.tolist() and np.allclose([r.distance for r in rows], d)
    assert np.isclose(model.avg_distance(labelled).first().avg_distance, d.mean())
    found = metrics.k_metrics(labelled, 10).first()
    assert np.isclose(found.inertia, d.sum()) and found.n_empty_clusters == 10 - len(set(label.tolist()))
    model.save(spark, str(tmp_path / "km"))
    assert np.array_equal(PQKMeansModel.load(spark, str(tmp_path / "km")).centers, model.centers)
    with pytest.raises(TypeError):
        PQKMeansModel.load(spark, str(tmp_path / "km/pq"))
    with pytest.raises(ValueError):
        PQKMeans(None, 3)
    one = metrics.k_sweep(spark, codes, pq, [4, 1000], str(tmp_path / "sweep"), 2)
    assert [r.k for r in metrics.k_sweep(spark, codes, pq, [4, 6], str(tmp_path / "sweep"), 2).collect()] == [4, 6] and one is not None


def test_binary(spark):
    model = PQModel(np.array([[[0.59], [0.6]], [[-1.7], [1.7]]]))
    df = spark.createDataFrame([([0, 0],), ([1, 1],)], "codes array<int>")
    assert [r.decoded for r in model.decode(df, binary=True).collect()] == [[0, 0], [1, 1]]
    assert [r.decoded for r in model.decode(df).collect()] == [[0, -1], [0, 1]]
    assert model.decode(df, round=False).where(F.col("decoded")[1] < -1.6).count() == 1


def test_nearest_takes_the_lowest_of_equal_ones():
    rnd = np.random.default_rng(2)
    for x, words in ((rnd.integers(-3, 4, (500, 6)), rnd.integers(-3, 4, (2, 40, 3))), (rnd.normal(size=(500, 6)) * 1e3 + 1e6, rnd.normal(size=(2, 40, 3)) * 1e3 + 1e6)):
        x, words = x.astype(float), words.astype(float)
        words[:, 20:] = words[:, :20]  # every codeword twice
        apart = [((x[:, None, s * 3:s * 3 + 3] - words[s][None]) ** 2).sum(axis=2) for s in range(2)]
        got = nearest(x, words)
        for s in range(2):
            assert (got[:, s] == apart[s].argmin(axis=1)).all()


def test_strategies_agree(spark):
    df, _ = vectors(spark, n=80)
    encoder = PQEncoder(k=6, m=3, iterations=2, integer=True)
    codes = encoder.fit_transform(df).orderBy("id").collect()
    pq = encoder.model
    assert pq.encode(df, strategy="relational").orderBy("id").collect() == codes
    model = PQKMeansModel.from_centers(pq, [[0, 1, 2], [3, 3, 3], [0, 1, 2], [5, 0, 4]])
    one, two = (sorted(tuple(r) for r in model.assign(pq.encode(df), with_distance=True, strategy=s).select("id", "cluster_id", "distance").collect()) for s in ("vectorized", "relational"))
    assert one == two and not any(r[1] == 2 for r in one)
    assert np.array_equal(PQKMeansModel.from_centers(pq, model.centers_frame(spark)).centers, model.centers)
    for wrong in ([[0, 1]], [[0, 1, 6]], []):
        with pytest.raises(ValueError):
            PQKMeansModel.from_centers(pq, wrong)
    with pytest.raises(ValueError):
        pq.encode(df, strategy="other")


def test_kmeans_plus_plus_starts_on_rows(spark):
    df, x = vectors(spark)
    words = PQEncoder(k=8, m=4, iterations=0, init="kmeans++", seed=3).fit(df).codewords
    for s in range(4):
        rows = {tuple(r) for r in x[:, 3 * s:3 * s + 3].astype(float).tolist()}
        assert {tuple(w) for w in words[s].tolist()} <= rows and len({tuple(w) for w in words[s].tolist()}) == 8


def test_early_stop(spark):
    df, _ = vectors(spark, n=60)
    pq = PQEncoder(k=6, m=3, iterations=1).fit(df)
    estimator = PQKMeans(pq, 3, iterations=50)
    model = estimator.fit(pq.encode(df))
    assert model.iterations_run < 50 and (estimator.history[-1] <= 1e-3 or model.iterations_run > 1)
    labels = estimator.fit_predict(pq.encode(df))
    assert labels.select("cluster_id").collect() == model.assign(pq.encode(df)).select("cluster_id").collect()


@pytest.mark.parametrize("whole", [True, False])
def test_closest_is_exact_with_ties(whole):
    rnd = np.random.default_rng(4)
    tables = rnd.integers(0, 5, (3, 6, 6)).astype(float) if whole else rnd.random((3, 6, 6)) + 1e3
    codes, centers = rnd.integers(0, 6, (300, 3)), rnd.integers(0, 6, (1300, 3))
    apart = sum(tables[s][codes[:, s]][:, centers[:, s]] for s in range(3))
    label, d = closest(codes, centers, tables)
    apart = np.stack([[tables[np.arange(3), c, z].sum() for z in centers[:40]] for c in codes]) if not whole else apart
    if whole:
        assert (label == apart.argmin(axis=1)).all() and (d == apart.min(axis=1)).all()
    else:
        label, d = closest(codes, centers[:40], tables)
        assert (label == apart.argmin(axis=1)).all() and (d == apart.min(axis=1)).all()
