import logging

import numpy as np
import pytest

from tessera.__main__ import main
from tessera.functions.fingerprints import short_time
from tessera.operators.pqkmeans import PQKMeansModel
from tessera.plans.progress import Throughput, timed
from tessera.sources.arrays import save_chunk


@pytest.fixture
def files(tmp_path):
    (tmp_path / "in").mkdir()
    lines = ["C" * k + g for k in range(1, 16) for g in ("", "O", "N", "Cl")]
    (tmp_path / "in/a.smi").write_text("\n".join([*lines, "", "  "]))
    return tmp_path


def test_step_by_step(spark, files):
    """Features, codebook, codes, centers, labels, sweep and maps, each by its own command."""
    at = lambda name: str(files / name)
    main(["features", at("in"), at("features")])
    assert spark.read.parquet(at("features")).count() == 60
    main(["train", at("features"), at("encoder"), "--k", "6", "--iterations", "2", "--n-train", "1000"])
    main(["encode", at("in"), at("encoder"), at("codes")])
    assert spark.read.parquet(at("codes")).columns == ["smiles", "codes"]
    main(["fit", at("codes"), at("encoder"), at("clusters"), "--k", "4", "--iterations", "3", "--labels", at("labels")])
    main(["label", at("codes"), at("clusters"), at("again"), "--with-distance"])
    one, two = (sorted((r.smiles, r.cluster_id) for r in spark.read.parquet(at(n)).collect()) for n in ("labels", "again"))
    assert one == two and len(one) == 60
    main(["assign", at("in"), at("clusters"), at("streamed"), at("checkpoint")])
    assert sorted((r.smiles, r.cluster_id) for r in spark.read.parquet(at("streamed")).collect()) == one
    main(["assign", at("in"), at("clusters"), at("streamed"), at("checkpoint")])  # nothing new
    (files / "in/b.smi").write_text("CCCCCC\n")
    main(["assign", at("in"), at("clusters"), at("streamed"), at("checkpoint")])
    assert spark.read.parquet(at("streamed")).count() == 61
    main(["sweep", at("encoder"), at("sweep"), "--codes", at("codes"), "--k", "2", "3", "--iterations", "2", "--n-subsample", "40", "--plot", at("k.svg")])
    assert [r.n_subsample for r in spark.read.parquet(at("sweep")).collect()] == [40, 40] and (files / "k.svg").read_text().count("<circle") == 8
    main(["sweep", at("encoder"), at("sweep2"), "--k", "2", "--iterations", "1", "--n-subsample", "50"])
    main(["map", at("r.html"), "--results", at("labels"), "--representative", "--kind", "mqn", "--k", "3"])
    main(["map", at("s.html"), "--smiles", at("in/b.smi"), "--bits", "256", "--radius", "2"])
    spark.read.parquet(at("labels")).select("smiles", "cluster_id").toPandas().to_csv(at("c.csv"), index=False)
    main(["map", at("c.html"), "--cluster-file", at("c.csv"), "--cluster", str(one[0][1]), "--kind", "mqn", "--properties", "mw"])
    assert all("canvas" in (files / f"{x}.html").read_text() for x in "rsc")
    with pytest.raises(ValueError):
        main(["map", at("x.html")])


def test_arrays_and_wide_codes(spark, files):
    x = np.random.default_rng(0).integers(0, 9, (40, 12))
    save_chunk(x, str(files / "npy"), 0)
    main(["train", str(files / "npy"), str(files / "encoder"), "--k", "5", "--m", "3", "--iterations", "1"])
    codes = np.random.default_rng(1).integers(0, 5, (30, 3))
    spark.createDataFrame([tuple(map(int, r)) for r in codes], "pq_0 int, pq_1 int, pq_2 int").write.parquet(str(files / "wide"))
    np.savez(files / "wide.npz", codes=codes)
    for name in ("wide", "wide.npz"):
        main(["fit", str(files / name), str(files / "encoder"), str(files / f"{name}-model"), "--k", "3", "--iterations", "2", "--labels", str(files / f"{name}-labels")])
        rows = spark.read.parquet(str(files / f"{name}-labels"))
        assert sorted(map(tuple, (r.codes for r in rows.collect()))) == sorted(map(tuple, codes.tolist()))
        assert len(PQKMeansModel.load(spark, str(files / f"{name}-model")).centers) == 3


def test_times_and_rates(spark, caplog):
    assert [short_time(s) for s in (5.25, 90, 7200)] == ["5.2 s", "1.5 min", "2.0 h"]
    with caplog.at_level(logging.INFO, "tessera"):
        assert timed(lambda x: x + 1)(2) == 3
        listener = Throughput(total=100)

        class Event:
            class progress:
                numInputRows = 25

        listener.onQueryProgress(Event)
    assert listener.rows == 25 and "left" in caplog.text and "took" in caplog.text
