import math
import random
import zlib

import numpy as np

from tessera.llm import toxicity
from tests.llm.conftest import DOC_SCHEMA


def made(n, seed=0):
    """Documents of invented words; toxic ones hold a few of four words, later ones misspelt."""
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice(["ra", "to", "mi", "sel", "gun", "ve", "pol"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    bad, rows, labels = ["horribleness", "detestable", "abominator", "wretchedly"], [], []
    for k in range(n):
        words, y = [rnd.choice(plain) for _ in range(rnd.randint(20, 200))], int(rnd.random() < 0.3)
        for _ in range(y * max(1, len(words) // 30)):
            w = rnd.choice(bad)
            at = rnd.randrange(1, len(w) - 1)
            words.insert(rnd.randrange(len(words)), w if k < n // 2 else w[:at] + w[at] + w[at:])
        rows.append((k, " ".join(words), "en", "a", 1))
        labels.append((k, 1, y))
    return rows, labels


def test_held_out_misspellings(spark):
    rows, labels = made(500)
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train_on(docs, known)
    got = {r.doc_id: r.toxic_score for r in toxicity.score(docs, model).collect()}
    later = [(got[k] >= toxicity.THRESHOLD, y == 1) for k, _, y in labels if k >= 250 and zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(a == b for a, b in later) / len(later) > 0.9


def test_edges(spark, docs_rows):
    docs = spark.createDataFrame([*docs_rows, (1, "again", None, None, None), (None, "no id", None, None, None)], DOC_SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train_on(docs, none) is None
    assert {r.toxic_score for r in toxicity.score(docs, None).collect()} == {0.0}
    model = toxicity.fit(["fine words", "bad words", "fine thing", "bad thing"] * 8, [0, 1, 0, 1] * 8, 0.5)
    out = toxicity.score(docs, model)
    assert out.count() == len(docs_rows) + 2 and out.columns == [*docs.columns, "toxic_score"]
    assert {r.toxic_score for r in out.where("text is null or text = ''").collect()} == {0.0}
    held = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out(docs.doc_id).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(k).encode()) % 3 == 1) for k, h in held.items() if k is not None) and held[None] is False
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_every_window_is_scored():
    model = toxicity.Model(np.zeros(1), 0.0, 1.0, 0.0)
    for n in (8, 9, 14, 40):
        for at in range(n - 7):
            values = np.zeros(n)
            values[[at, at + 7]] = 1.0
            assert model.logit(values) == 2 / toxicity.WINDOW
    clean = ["soft", "warm", "plain", "green", "quiet", "round", "early", "broad"] * 4
    texts = [" ".join(clean[k % 5:] + ["vile", "hush", "foul"] * (k % 2)) for k in range(40)]
    fitted = toxicity.fit(texts, [k % 2 for k in range(40)], 0.5)
    scores = []
    for lead in range(4):
        values = fitted.word_values(clean[:lead + 1][::-1] + ["vile"] + clean[:6] + ["foul"] + clean)
        scores.append(fitted.logit(values))
    best = max(sum(values[a:a + 8]) for a in range(len(values) - 7)) / 8 + fitted.bias
    assert abs(scores[-1] - best) < 1e-6 and max(scores) - min(scores) < 1e-6


def test_all_of_a_long_word_is_scored():
    clean = "soft.warm.plain.green.quiet.round.early.broad." * 4
    for at in range(60, 120, 7):
        glued = clean[:at] + "abominator" + clean[at:]
        assert any("abominator" in w for w in toxicity.words(glued)) and toxicity.words("short " + glued)[0] == "short"
        assert all(any(glued[a:a + 5] in w for w in toxicity.words(glued)) for a in range(len(glued) - 5))
    fitted = toxicity.fit([f"word{k % 3} " + ("abominator" if k % 2 else "harmless") for k in range(40)], [k % 2 for k in range(40)], 0.5)
    one, two = (fitted.logit(fitted.word_values(toxicity.words(clean[:-1] + t))) for t in ("harmless", "abominator"))
    assert one < two
    assert max(len(w) for w in toxicity.words("x" * 5000 + " y")) <= toxicity.LONGEST and toxicity.pieces("x" * 64) == ["x" * 64]


def plain_score(model, text):
    """Every window's mean of its words' means of n-gram values, one by one."""
    found = [w.strip(toxicity._EDGE) for w in (text or "").lower().split()]
    if any(len(w) > toxicity.LONGEST for w in found):
        found = [w[a:a + toxicity.LONGEST] for w in found for a in range(0, max(1, len(w) - 32), 32)]
    bag = [w for k, w in enumerate(found) if w and (k == 0 or found[k - 1] != w)]
    if not bag:
        return 0.0
    values = []
    for w in bag:
        marked = f"<{w}>"
        buckets = [zlib.crc32(marked.encode()) % toxicity.BUCKETS]
        for gram in (marked[i:i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)):
            rolled = 0
            for c in gram:
                rolled = (rolled * 0x100000001B3 + ord(c)) % 2**64
            buckets.append(rolled * 0x9E3779B97F4A7C15 % 2**64 >> 46)
        values.append(sum(float(model.value[b]) for b in buckets) / len(buckets))
    windows = [sum(values[a:a + 8]) / 8 for a in range(max(1, len(values) - 7))]
    return 1 / (1 + math.exp(-min(30, max(-30, model.slope * (max(windows) + model.bias) + model.shift))))


def test_scores_against_plain_windows(spark, docs_rows, monkeypatch):
    monkeypatch.setattr(toxicity, "MEMO_WORDS", 50)  # it starts anew again and again
    rows, labels = made(120, 5)
    rows += [(1000 + k, *r[1:]) for k, r in enumerate(docs_rows)]
    rows += [(2000, "x.y-z " * 30 + "q" * 500 + " abominator abominator , , abominator", "en", "a", 1), (2001, "Abominator, (abominator) - \"ABOMINATOR\"", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    model = toxicity.train_on(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in toxicity.score(docs, model).collect():
        assert abs(r.toxic_score - plain_score(model, r.text)) < 1e-5, r


def test_reject_takes_any_columns(spark, tmp_path):
    rows, labels = made(120, 6)
    rows.append(rows[0])
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(*r, 0.9, "y", 1) for r in rows] + [(None, None, None, None, None, None, None, None)], DOC_SCHEMA + ", toxic_score double, TOXIC string, model int")
    out = toxicity.reject(spark, docs, str(tmp_path))
    model = toxicity.train_on(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert out.columns == docs.columns
    want = sorted((r.doc_id for r in docs.collect() if plain_score(model, r.text) < toxicity.THRESHOLD), key=str)
    assert sorted((r.doc_id for r in out.collect()), key=str) == want and len(want) < len(rows)
    assert toxicity.reject(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    docs = spark.createDataFrame([(k % 9, f"text {k}", "en", "a", 1) for k in range(300)], DOC_SCHEMA)
    assert toxicity.train_on(docs, spark.createDataFrame([(k, 1, k % 2) for k in range(9)], "doc_id long, quality int, toxic int")) is not None
