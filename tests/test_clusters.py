import warnings
from collections import Counter

import pytest

from tessera.operators import clusters
from tessera.sources.paths import quoted, results

#: 53 molecules in five clusters of unequal sizes, whose ids are not dense.
ROWS = [("N" + "C" * k, 3 * ((k * k + k // 4) % 5) - 1) for k in range(53)]
SIZES = dict(sorted(Counter(c for _, c in ROWS).items()))
LARGEST = max(SIZES, key=lambda c: (SIZES[c], -c))


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "results")
    for k in range(3):
        spark.createDataFrame(ROWS[k::3], "smiles string, cluster_id long").coalesce(1).write.mode("append").parquet(path)
    return path


def test_questions(spark, folder):
    rows = results(spark, folder)
    assert [(r.cluster_id, r.molecule_count) for r in clusters.cluster_stats(rows).collect()] == list(SIZES.items())
    assert [r.cluster_id for r in clusters.cluster_ids(rows).collect()] == list(SIZES)
    assert clusters.total(rows).first().total == len(ROWS)
    for c in (*SIZES, 99):
        assert sorted(r.smiles for r in clusters.query_cluster(rows, c).collect()) == sorted(x for x, own in ROWS if own == c)
    assert clusters.query_cluster(rows, 2, columns=["smiles"]).columns == ["smiles"]
    assert clusters.query_clusters_batch(rows, [2, 8]).count() == SIZES.get(2, 0) + SIZES.get(8, 0) and clusters.query_clusters_batch(rows, []).count() == 0
    assert clusters.query_clusters_batch(rows, range(2, 3000)).count() == sum(n for c, n in SIZES.items() if c >= 2)
    assert clusters.top_clusters(rows, 1).first().cluster_id == LARGEST and clusters.largest_cluster(rows).count() == SIZES[LARGEST]
    with pytest.warns(UserWarning, match="no rows"):
        assert clusters.query_cluster(rows, 99, warn=True).count() == 0
    one, two = (sorted(r.smiles for r in clusters.sample_from_cluster(rows.repartition(n), LARGEST, 2, 7).collect()) for n in (1, 5))
    assert one == two and len(one) == 2
    assert clusters.representatives(rows, 1).count() == len(SIZES)
    plan = clusters.query_cluster(rows, 1, columns=["smiles"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(cluster_id,1)" in plan


def test_export(spark, folder, tmp_path):
    rows = results(spark, folder)
    want = sorted(x for x, c in ROWS if c == LARGEST)
    for ending, header in (("csv", 1), ("smi", 0), ("txt", 0)):
        path = str(tmp_path / f"deep/one.{ending}")
        assert clusters.export_cluster(rows, LARGEST, path) == len(want)
        assert sorted(x.split(",")[0] for x in open(path).read().splitlines()[header:]) == want
    assert clusters.export_cluster(rows, LARGEST, str(tmp_path / "one.parquet")) == len(want)
    assert spark.read.parquet(str(tmp_path / "one.parquet")).count() == len(want)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert clusters.export_cluster(rows, 42, str(tmp_path / "none.csv")) == 0 and said
    assert not (tmp_path / "none.csv").exists()
    with pytest.raises(ValueError):
        clusters.export_cluster(rows, 1, str(tmp_path / "one.xyz"))
    assert clusters.export_all_clusters(rows, str(tmp_path / "all")) == SIZES
    assert spark.read.parquet(str(tmp_path / "all")).where(f"cluster_id = {LARGEST}").count() == len(want)


def test_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        results(spark, str(tmp_path / "missing"))
    (tmp_path / "file").write_text("x")
    with pytest.raises(ValueError, match="folder"):
        results(spark, str(tmp_path / "file"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="holds no Parquet"):
        results(spark, str(tmp_path / "empty"))
    assert quoted("a`b") == "`a``b`" and quoted("`a`") == "`a`"
