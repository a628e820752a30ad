import numpy as np
import pytest

from tessera.functions.fingerprints import _FEATURIZERS, featurize, format_time, mol_props, morgan, mqn, register_featurizer
from tessera.functions.smiles import SmilesError, from_molblock, parse, to_molblock, to_smiles
from tessera.operators.graph import knn_graph, spanning_tree, tree_map
from tessera.plans.pipeline import Config, Pipeline
from tessera.sources import arrays, text
from tessera.sources.paths import expand_paths

DRUGS = ["CC(=O)Oc1ccccc1C(=O)O", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "c1ccc2[nH]ccc2c1", "C[N+](C)(C)CC([O-])=O", "C1CC2CCC1C2", "N#Cc1ccncc1", "O=S(=O)(c1ccccc1)N", "F/C=C/Cl", "C%12CCCC%12", "[Na+].[Cl-]"]


def test_quantum_numbers():
    benzene = mqn(parse("c1ccccc1"))
    assert len(benzene) == 42 and benzene[0] == 6 and benzene[11] == 6 and benzene[15:17] == [3, 3] and benzene[35] == 1 and benzene[29] == 6
    aspirin = mqn(parse(DRUGS[0]))
    assert (aspirin[0], aspirin[9], aspirin[11], aspirin[13], aspirin[16], aspirin[22]) == (9, 4, 13, 2, 3, 1)
    naphthalene = mqn(parse("c1ccc2ccccc2c1"))
    assert naphthalene[35] == 2 and naphthalene[40:] == [2, 1] and naphthalene[16] == 5
    betaine = mqn(parse(DRUGS[3]))
    assert betaine[23:25] == [1, 1] and betaine[28] == 1
    assert mqn(parse("C1CC2CCC1C2"))[34] == 2  # two five-rings of a bridged one
    assert mqn(parse("N#CC"))[14] == 1


@pytest.mark.parametrize("smiles", DRUGS)
def test_round_trip(smiles):
    mol = parse(smiles)
    again = parse(to_smiles(mol))
    assert mqn(mol) == mqn(again) and sorted(a.hydrogens for a in mol.atoms) == sorted(a.hydrogens for a in again.atoms)


@pytest.mark.parametrize("bad", ["", "C(", "C)", "C1CC", "CX", "C==C", "[Zz]", "C(C)(C)(C)(C)C", "c1cccc1", "(C)"])
def test_unreadable(bad):
    with pytest.raises(SmilesError):
        parse(bad)


def test_morgan():
    a, b = (morgan(parse(s), 512, 2) for s in ("CCO", "OCC"))
    assert a == b and sum(a) >= 5 and set(a) == {0, 1} and morgan(parse("CCN"), 512, 2) != a
    with pytest.raises(ValueError):
        morgan(parse("C"))


def test_featurize(spark):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(["CCO", "bad(", "c1ccccc1", None, "CCO"])], "id long, smiles string")
    rows = featurize(df).orderBy("id").collect()
    assert [r.id for r in rows] == [0, 2, 4] and rows[0].fp == rows[2].fp
    assert len(featurize(df, "morgan", fp_size=1024, radius=3).first().fp) == 1024
    for bad in (lambda: featurize(df, "morgan"), lambda: featurize(df, "nothing"), lambda: mol_props(df, ["nothing"])):
        with pytest.raises(ValueError):
            bad()
    got = mol_props(df, ["mw", "n_rings"]).orderBy("id").collect()
    assert abs(got[0].mw - 46.069) < 0.01 and got[2].n_rings == 1 and got[1].mw is None
    assert featurize(df.limit(0)).count() == 0 and format_time(3725.5) == "1 h; 2min; 5.50 s"


def test_features_of_distinct_molecules(spark):
    """Each distinct molecule is computed once, not every row of what they were drawn from."""
    calls = spark.sparkContext.accumulator(0)

    def counted(mol, fp_size, radius):
        calls.add(1)
        return morgan(mol, fp_size, radius)

    df = spark.createDataFrame([(k, "C" * (1 + k % 5)) for k in range(200)], "id long, smiles string").repartition(4)
    register_featurizer("counted", counted)
    try:
        rows = featurize(df.select("smiles").distinct(), "counted", fp_size=64, radius=2).collect()
    finally:
        _FEATURIZERS.pop("counted")
    assert sorted(r.smiles for r in rows) == ["C" * k for k in range(1, 6)] and calls.value == 5


def test_scans(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ["CCO\tethanol 1", "  c1ccccc1\u2003benzene", "O", "\t \t", "", "N#N nitrogen\u00a0gas   ", "CC(=O)O,acid", "[Na+].[Cl-]   salt,of;sodium\r"]
    (tmp_path / "in/a.txt").write_text("\n".join(lines) + "\n")
    tokens = [x.split() for x in lines]
    for col in range(3):
        assert [r.smiles for r in text.scan_text(spark, str(tmp_path / "in"), col).collect()] == [t[col] for t in tokens if len(t) > col]
    assert text.scan_text(spark, [str(tmp_path / "in/*.txt")]).count() == sum(map(bool, tokens))
    with pytest.raises(FileNotFoundError):
        text.scan_text(spark, str(tmp_path / "missing"))
    with pytest.raises(TypeError):
        expand_paths(spark, 5)
    lines = spark.createDataFrame([("f", k) for k in range(5)] + [("g", 0)], "file string, pos int")
    sizes = text.chunk_ids(lines, 2, "file", "pos").groupBy("file", "chunk").count().orderBy("file", "chunk").collect()
    assert [r["count"] for r in sizes] == [2, 2, 1, 1]
    x = np.arange(12).reshape(4, 3)
    for k in range(2):
        arrays.save_chunk(x + k, str(tmp_path / "npy"), k)
    assert arrays.scan_npy(spark, str(tmp_path / "npy"), limit=5).count() == 5
    arrays.save_chunk(x, str(tmp_path / "wide"), 0, "parquet")
    assert arrays.scan_codes(spark, str(tmp_path / "wide")).first().codes == [0, 1, 2]
    with pytest.raises(ValueError):
        arrays.save_chunk(x, str(tmp_path), 0, "xyz")
    assert arrays.code_columns(["pq_10", "pq_2", "smiles"]) == ["pq_2", "pq_10"]
    codes = arrays.gen_codes(spark, 10, 3, 8)
    assert arrays.to_array(arrays.to_wide(codes, "codes", 3, "pq_")).orderBy("id").collect() == codes.orderBy("id").collect()


def test_sdf(spark, tmp_path):
    block = "\n  x\n\n  3  2  0  0  0  0  0  0  0  0999 V2000\n" + "".join(f"{0.0:10.4f}{0.0:10.4f}{0.0:10.4f} {s:<3} 0  0\n" for s in "CCO") + "  1  2  1  0\n  2  3  1  0\nM  END\n"
    assert to_smiles(from_molblock(block)) == "CCO" and from_molblock("junk") is None
    for smiles in ("CCO", "c1ccccc1", "CC(=O)[O-]", "C[N+](C)(C)C", "C#N", "FC(Cl)Br"):
        again = from_molblock(to_molblock(parse(smiles)))
        assert mqn(again) == mqn(parse(smiles)), smiles
    (tmp_path / "m.SDF").write_text(block + "$$$$\n" + "junk\n$$$$\n" + block + "$$$$\n")
    assert [r.smiles for r in text.scan_text(spark, str(tmp_path / "m.SDF")).collect()] == ["CCO", "CCO"]


def test_graph(spark, tmp_path):
    df = spark.createDataFrame([(k, [float(k % 7), float(k // 7)]) for k in range(40)], "id long, fp array<double>")
    x = {r.id: np.array(r.fp) for r in df.collect()}
    for r in knn_graph(df, 3).collect():
        want = sorted((float(np.sqrt(((x[r.src] - v) ** 2).sum())), j) for j, v in x.items() if j != r.src)[r["rank"] - 1]
        assert (r.dist, r.dst) == pytest.approx(want)
    assert len(spanning_tree([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0)])) == 2
    smiles = spark.createDataFrame([("C" * k, k % 2) for k in range(1, 9)], "smiles string, cluster_id int")
    assert tree_map(smiles, str(tmp_path / "m.html"), k=3, properties=["mw"], cluster_col="cluster_id").count() == 7
    assert "canvas" in (tmp_path / "m.html").read_text()
    with pytest.raises(ValueError):
        tree_map(smiles, str(tmp_path / "n.html"), properties=["nothing"])


def test_pipeline_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.smi").write_text("\n".join("C" * k + g for k in range(1, 20) for g in ("", "O", "N", ")")))
    config = Config(f"{tmp_path}/in", f"{tmp_path}/out", k_codes=4, pq_iterations=2, k_clusters=3, iterations=2)
    assert Pipeline(spark, config).run().count() == 57
    ran = []
    again = Pipeline(spark, config)
    again.assigned = lambda: ran.append(1)
    assert again.run().count() == 57 and not ran
