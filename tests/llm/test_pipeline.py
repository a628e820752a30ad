import random

import corpus_pipeline
from tessera.llm import pii, toxicity
from tessera.llm.common import table
from tests.llm.conftest import DOC_SCHEMA
from tests.llm.test_jaccard import brute
from tests.llm.test_token_files import library

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, DATA, "documents")
    model = toxicity.train_on(docs, table(spark, DATA, "labels"))
    rows = [tuple(r)[:5] for r in toxicity.score(docs, model).collect() if r.toxic_score < toxicity.THRESHOLD]
    kept = {doc_id for doc_id, _, component in brute(rows) if doc_id == component}
    rows = [r for r in rows if r[0] in kept]
    sensitive = pii.train(spark.createDataFrame(rows, docs.schema))
    want = {}
    for doc_id, text, *_ in rows:
        want[doc_id] = len(library(pii.masked(text or "", sensitive))) + 1
    got: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, DATA).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_near_copies_take_five_words_and_four_fifths(spark):
    base = [f"w{k}" for k in range(100)]
    more = [f"m{k}" for k in range(30)]
    rows = [(1, " ".join(base), "en", "a", 1), (2, " ".join(base + more[:20]), "en", "a", 1), (3, "x " + " ".join(base[::-1]), "en", "a", 1), (4, "x " + " ".join(base[::-1] + more), "en", "a", 1)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOC_SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]  # 96 of 116 five-word shingles, 97 of 127


def test_odd_tables(spark, tmp_path, docs_rows):
    """Empty tables, clashing names, missing ids and repeated rows go through every stage."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    rows = [(100 + k, " ".join(rng.choices(words, k=40)) + (" vile foul" * 5 if k % 4 == 0 else ""), "en", "a", 1) for k in range(80)]
    rows += [*docs_rows, docs_rows[0], (None, "no id but mail a.b@example.org", None, None, None), (None, None, None, None, None)]
    spark.createDataFrame([(r[0], 1, int(r[0] % 4 == 0)) for r in rows[:80]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["toxic_score", "kept_id", "KEPT_HASH", "kept_rid", "kept_text", "piece", "part", "key"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], DOC_SCHEMA + "".join(f", {n} int" for n in names)).drop("n_chars")
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 3:
            assert now.columns == docs.columns, name
            now.write.parquet(f"{tmp_path}/{k}")
            now = spark.read.parquet(f"{tmp_path}/{k}")
    kept = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/2").collect()]
    assert kept.count(1) == 1 and kept.count(4) + kept.count(5) == 1 and kept.count(None) == 2 and {2, 3, 6, 7} <= set(kept)
    assert not {r[0] for r in rows[:80] if r[0] % 4 == 0} & set(kept)
    assert sorted((r.doc_id for r in now.collect() if r.piece == 0), key=str) == sorted(kept, key=str)
    masked = spark.read.parquet(f"{tmp_path}/2").where("text like '%no id but mail%'").first().text
    assert masked == "no id but mail [EMAIL]"
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert now.count() == 0
