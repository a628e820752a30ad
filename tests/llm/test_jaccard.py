import random
import re
import time

import pytest

from tessera.llm import components, jaccard
from tessera.llm.common import Scratch
from tests.llm.conftest import DOC_SCHEMA


def sets(rows):
    out = []
    for _, text, *_ in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(words[i:i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set())
    return out


def brute(rows):
    s = sets(rows)
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= 85 * (len(s[i]) + len(s[j]) - both):
                part[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s[i]), ids.get(find(i)) if s[i] else r[0]) for i, r in enumerate(rows)), key=str)


def near_copies(seed, groups=12, each=14):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 30, 90, 200]))]
        if rnd.random() < 0.5:
            base += passage
        for _ in range(rnd.randint(1, each)):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                at = rnd.randrange(len(words))
                words[at:at + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [words[at].upper(), "x"]])
                words = words or ["w"]
            rows.append((len(rows) * 7 % 1009, " ".join(words), "en", "a", 1))
    rnd.shuffle(rows)
    return rows


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)
    assert got(jaccard.cluster(df, Scratch(spark))) == brute(rows)


def test_hot_runs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "RUN_ROWS", 6)
    monkeypatch.setattr(jaccard, "RUN_ROOTS", 1)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(components, "FEW_LINKS", 2)
    monkeypatch.setattr(jaccard, "HUB_MEMBERS", 2)
    rows = near_copies(9, groups=5, each=40)
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)
    assert got(jaccard.cluster(df, Scratch(spark))) == brute(rows)


def test_halves_of_digests_agree(spark, monkeypatch):
    real = jaccard.set_key
    monkeypatch.setattr(jaccard, "set_key", lambda grams: (real(grams)[0] % 7, real(grams)[1]))
    rows = near_copies(3, groups=6, each=5)
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    scratch = Scratch(spark)
    assert len(jaccard._scanned(df, scratch, 4, "doc_id", "text")[3]) > 3
    assert got(jaccard.cluster(df, Scratch(spark))) == brute(rows)


def test_heavy_grams_in_slots(spark, monkeypatch):
    """A passage rarer than nothing else in a third of all rows: its runs are dealt in slots and blocks."""
    monkeypatch.setattr(jaccard, "SLOT_ROWS", 20)
    monkeypatch.setattr(jaccard, "RUN_ROWS", 20)
    monkeypatch.setattr(jaccard, "RUN_ROOTS", 2)
    monkeypatch.setattr(jaccard, "BATCH_ROWS", 100)
    rnd = random.Random(4)
    passage = [f"p{k}" for k in range(30)]
    rows = [(k, " ".join(passage + [f"w{rnd.randrange(50)}" for _ in range(rnd.choice([2, 4, 6]))]) if k % 3 == 0 else f"own text {k} of few words", "en", "a", 1) for k in range(400)]
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(2)
    docs, scanned, *_ = jaccard._scanned(df, Scratch(spark), 4, "doc_id", "text")
    assert max(jaccard._heavy(scanned).values()) > 3
    assert got(jaccard.cluster(df, Scratch(spark))) == brute(rows)


def test_whole_texts_stay_where_they_are(spark, monkeypatch):
    """With lists too long to broadcast, only texts that a list may name are shuffled to be looked up."""
    rnd = random.Random(5)
    rows = [(k, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(2000)), "en", "a", 1) for k in range(120)]
    rows += [(k, rows[k % 3][1] + " more" * (k % 2), "en", "a", 1) for k in range(200, 206)] + [(300, "twice the same row", "en", "a", 1)] * 2 + [(301, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(4).localCheckpoint()
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        time.sleep(1)
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(True).head().totalShuffleWrite()

    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.deduplicate(spark, df, "")
        before = shuffled()
        assert sorted(r.doc_id for r in kept.collect()) == [*range(120), 300, 301, 301]
        assert shuffled() - before < 0.2 * sum(len(r[1] or "") for r in rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges(spark, docs_rows):
    long = " ".join(f"t{k % 997}x{k}" for k in range(20_000))
    rows = [*docs_rows, (8, " \t\n", None, None, None), (None, "plain words here\nnext line of WORDS", None, None, None), (None, None, None, None, None), (None, "only without an id", None, None, None),
            (4, "plain words here\nnext line of words", "x", "x", 1), (30, long, "en", "a", 1), (31, long + " more", "en", "a", 1)]
    rows += [(40, "", "en", "a", 1), (40, "", "en", "a", 1), (41, "one id of two texts", "en", "a", 1), (41, "quite another text of that id", "en", "a", 1), (42, "one ID of two texts", "en", "a", 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOC_SCHEMA + ", component_id int, kept_id int, KEPT_hash int")
    assert got(jaccard.cluster(df, Scratch(spark))) == brute(rows)
    kept = jaccard.deduplicate(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, 8, 30, 40, 40, 41, 41, None, None], key=str)
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert jaccard.cluster(empty, Scratch(spark)).count() == 0 and jaccard.deduplicate(spark, empty, "").count() == 0
