import itertools
import pathlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm import packing
from tessera.llm.common import Scratch
from tests.llm.conftest import DOC_SCHEMA
from tests.llm.test_token_files import library

PATH = P.path("byte_bpe_50k.json")


def fewest(items, capacity):
    """Brute force over all assignments, longest first, empty bins tried once."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[k] <= capacity:
                go(k + 1, [*bins[:j], bins[j] + items[k], *bins[j + 1:]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_fewest_bins(seed):
    rnd = random.Random(seed)
    items = [rnd.randint(1, 30 if seed % 2 else 17) for _ in range(rnd.randint(0, 14))]
    bins = packing.solve(np.bincount(items, minlength=31) if items else np.zeros(31, dtype=int), 30)
    assert sum(t for _, t in bins) == (fewest(items, 30) if items else 0)
    packed = [n for p, t in bins for n, c in p for _ in range(c * t)]
    assert sorted(packed) == sorted(items) and all(sum(n * c for n, c in p) <= 30 for p, _ in bins)


def slow_bound(counts, capacity):
    """The bound by its definition: pieces too long to share a bin with those of k and more."""
    items = [n for n, c in enumerate(counts) for _ in range(c)]
    best = -(-sum(items) // capacity)
    for k in range(capacity // 2 + 1):
        big = [x for x in items if x > capacity - k]
        mid = [x for x in items if capacity // 2 < x <= capacity - k]
        small = sum(x for x in items if k <= x <= capacity // 2)
        best = max(best, len(big) + len(mid) + max(0, -(-(small - sum(capacity - x for x in mid)) // capacity)))
    return best


def test_lower_bound():
    rnd = random.Random(1)
    for _ in range(200):
        counts = np.bincount([rnd.randint(1, 20) for _ in range(rnd.randint(1, 15))], minlength=21)
        assert packing.lower_bound(counts, 20) == slow_bound(counts, 20)


@pytest.mark.parametrize("n", [3000, 20_000, 200_000])
def test_the_search_places_every_piece_and_reaches_the_bound(n):
    rnd = np.random.default_rng(3)
    counts = np.bincount(np.minimum(rnd.lognormal(6, 1, n).astype(int) + 1, 2048), minlength=2049)
    bins, found = packing.searched(counts)
    assert found and sum(t for _, t in bins) == packing.lower_bound(counts, 2048)
    assert (sum(np.bincount(p, minlength=2049) * t for p, t in bins) == counts).all()
    if n > 100_000:  # where plain best fit misses it
        assert sum(t for _, t in packing._best_fit(counts, 2048)) > sum(t for _, t in bins)


def test_better_than_best_fit_on_triplets():
    """Pieces that fill bins only in threes: best fit wastes room, the search finds fewer bins, and often the fewest."""
    fewest_found = 0
    for seed in range(5):
        rnd, items = random.Random(seed), []
        for _ in range(12):
            a = rnd.randint(250, 490)
            b = rnd.randint(251, min(490, 749 - a))
            items += [a, b, 1000 - a - b]
        counts = np.bincount(items, minlength=1001)
        bins, found = packing.searched(counts, 1000)
        many = sum(t for _, t in bins)
        assert found and many < sum(t for _, t in packing._best_fit(counts, 1000))
        fewest_found += many == 12
    assert fewest_found >= 3


def test_pack(spark, docs_rows):
    rows = [*docs_rows, *((20 + i, "word " * (300 * i), "en", "a", 1) for i in range(12)), (4, "same id", None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOC_SCHEMA + ", piece int, PART int, length int").repartition(3)
    out = packing.pack(df, PATH, Scratch(spark), capacity=512).collect()
    by_seq = {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(spans)) and sum(n for _, n in spans) <= 512
    want = []
    for doc_id, text, *_ in rows:
        ids = [*library(text), 0]
        cut = len(ids) % 512 or 512
        cuts = [0, *range(cut, len(ids), 512), len(ids)] if len(ids) > 512 else [0, len(ids)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    total = sum(r.length for r in out)
    assert len(by_seq) == -(-total // 512)


def test_files_are_as_many_as_the_input_has_partitions(spark):
    """None for each shuffle partition: on a local disk each file made is a process that the executor starts."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("40", "false")):
            spark.conf.set(n, v)
        docs = spark.createDataFrame([(i, "word " * (i % 50), "en", "a", 1) for i in range(300)], DOC_SCHEMA).repartition(3)
        scratch = Scratch(spark)
        assert packing.pack(docs, PATH, scratch).count() == 300
        assert len(list(pathlib.Path(scratch.root.removeprefix("file://")).rglob("part-*.parquet"))) == 3
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOC_SCHEMA), PATH, Scratch(spark)).count() == 0
