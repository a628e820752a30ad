"""N-gram Jaccard join: rare-first prefix filtering, each pair verified once.

Documents are sets of distinct word n-grams; two link when PERCENT of their union is shared.
1. One pass makes each set's size and 128-bit key (documents whose sets are equal are one node from
   here on; nodes are known by 64 bits of the key, and by the other 64 where those agree for two
   sets), counts all n-grams in a table of 2**SKETCH_BITS counters, and finds those that very many sets hold.
2. A second pass orders every set by that count, rarest first (any order that all sets share is
   right, so shared counters only cost speed), and emits its prefix.  Two sets that link share a prefix n-gram.
3. Prefix n-grams are sorted into runs.  Rows whose neighbours fit by length stay; the runs of
   n-grams that very many hold are dealt in slots, where all rows stay.  The sets of nodes with
   such rows are stored once.  Each node is verified against one hub of its runs, and the links found
   are united: in a group of near copies this already joins nearly all with one test each.
4. Pairs of a run that are still in different components are tested by length, position and suffix
   (per range of hashes, the sizes of what two sets hold bound what they can share) inside the
   run.  First only the pair of each node that comes closest by suffix is verified, and its links
   united, again while this joins many components; then every pair still between components is, once, by
   the whole sets.  No pair that could change a component is left out; a run above RUN_ROWS is
   dealt as pairs of blocks.
Before whole sets are shuffled, a pair must pass the suffix filter again on finer ranges, whose
number grows with the set (an outline has a thirty-second of the set's bytes).  Rows with whole texts or
sets are not shuffled to be looked up in a list: a short list is broadcast, of a long one a sieve of
2**SIEVE_BITS bits is, and only rows that pass it are shuffled.
Components of links, not links, are the result, so pairs inside a component need no test.

A null or wordless text has no set and links with nothing; fewer words than n make one n-gram.
Rows with one id count each by itself; a null id never names a component that has another id.
An empty table gives no rows; columns but the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, fresh, table, text_batches
from tessera.llm.components import components
from tessera.llm.shingles import shingles

SIZE, PERCENT = 4, 85
SKETCH_BITS, SKETCH_CHUNK = 20, 1 << 14
#: Ranges of hashes whose sizes the suffix filter compares.
RANGES = 64
#: Members of a set for each range of its outline, by which a pair is compared before whole sets are.
OUTLINE = 4
#: Rows of a run above which it is dealt in blocks of half as many; c rows above the square of
#: RUN_ROWS / RUN_ROOTS in blocks of half RUN_ROOTS * sqrt(c), so a row is copied 2 * sqrt(c) / RUN_ROOTS times.
RUN_ROWS, RUN_ROOTS = 1000, 20
#: Rows of a slot of an n-gram that very many sets hold.
SLOT_ROWS = 20_000
#: An n-gram is looked at as one that very many sets hold if one in so many of a batch does, and is
#: one if of all sets one in HEAVY_SETS does; so there are at most HEAVY_SETS times a set's mean size.
HEAVY_BATCH, HEAVY_SETS = 20, 1000
#: Nodes up to which a list of them is broadcast (16 bytes each, 80 with suffixes); above, it is shuffled.
BROADCAST_ROWS = 200_000
#: Bits of a sieve (4 MB), and its bytes that are sent as one row.
SIEVE_BITS, SIEVE_CHUNK = 25, 1 << 14
#: Copies of the rows of a small side, so that a long set's rows are dealt over as many tasks.
SALTS = 16
#: Rows of an Arrow batch: of texts, sets or prefix n-grams.
BATCH_ROWS = 500
#: Rounds of closest pairs at most; what they leave is for the last round, which takes every pair.  Another
#: round is worth its cost if the one before joined as many parts as one in WORTH nodes.
CLOSEST_ROUNDS, WORTH = 3, 10
#: Members verified against a hub in one group.
HUB_MEMBERS = 50_000


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """Two halves of a 128-bit digest of the set."""
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def node_of(key: tuple[int, int], clashes: frozenset[int]) -> int:
    return key[1] if key[0] in clashes else key[0]


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """Rows of (doc_id, hash, n, key, more), and per partition rows of (chunk, counts) and (gram, held)."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("more", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary()), ("gram", pa.int64()), ("held", pa.int64())])

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        heavy: dict[int, int] = {}
        empty, shift = True, np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(2).to_pylist()]
            if grams := [s for s in sets if len(s)]:
                found, n = np.unique(np.concatenate(grams), return_counts=True)
                total += np.bincount((found >> shift).astype(np.int64), weights=n, minlength=len(total)).astype(np.int64)
                often = n * HEAVY_BATCH >= max(len(sets), HEAVY_BATCH * HEAVY_BATCH)
                for g, c in zip(found[often].view(np.int64).tolist(), n[often].tolist()):
                    heavy[g] = heavy.get(g, 0) + c
                empty = False
            keys = [set_key(s) if len(s) else (None, None) for s in sets]
            yield rows(doc_id=batch.column(0), hash=batch.column(1), n=[len(s) for s in sets], key=[k for k, _ in keys], more=[k for _, k in keys])
        if not empty:
            parts = total.reshape(-1, SKETCH_CHUNK)
            yield rows(chunk=range(len(parts)), counts=[np.minimum(p, 2**32 - 1).astype("<u4").tobytes() for p in parts])
        if heavy:
            yield rows(gram=list(heavy), held=list(heavy.values()))

    kinds = {"int64": "long", "int32": "int", "binary": "binary"}
    return docs.select("doc_id", "hash", "text").mapInArrow(run, ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema))


def _clashes(info: DataFrame) -> frozenset[int]:
    """Keys whose halves agree for unequal sets: by chance none below billions of sets, and a handful there."""
    ends = info.where("key is not null").groupBy("key").agg(F.min(F.struct("n", "more")).alias("a"), F.max(F.struct("n", "more")).alias("b"))
    found = ends.where("a <> b").select("key").limit(BROADCAST_ROWS + 1).collect()
    if len(found) > BROADCAST_ROWS:
        raise RuntimeError("too many sets agree in half of their digests")
    return frozenset(r.key for r in found)


def _heavy(scanned: DataFrame) -> dict[int, int]:
    """N-grams that very many sets hold, and in how many slots their rows are dealt."""
    held = scanned.where("gram is not null").groupBy("gram").agg(F.sum("held").alias("held")).where(F.col("held") > SLOT_ROWS)
    if held.limit(1).count() == 0:
        return {}
    least = scanned.where("n > 0").count() / HEAVY_SETS
    return {r.gram: -(-r.held // SLOT_ROWS) for r in held.where(F.col("held") >= least).collect()}


def _sketch(rows: DataFrame) -> np.ndarray:
    """The sum of all partitions' counters; 4 bytes for each of 2**SKETCH_BITS, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(counts, dtype="<u4").astype(np.uint64)
                total[chunk] = total[chunk] + more if chunk in total else more
        out = [np.minimum(c, 2**32 - 1).astype("<u4").tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int32()), pa.array(out, type=pa.binary())], names=["chunk", "counts"])

    sketch = np.zeros((1 << SKETCH_BITS) // SKETCH_CHUNK * SKETCH_CHUNK, dtype=np.uint32)
    for r in rows.select("chunk", "counts").where("chunk is not null").repartition("chunk").mapInArrow(run, "chunk int, counts binary").collect():
        sketch[r.chunk * SKETCH_CHUNK:(r.chunk + 1) * SKETCH_CHUNK] = np.frombuffer(r.counts, dtype="<u4")
    return sketch


def _postings(docs: DataFrame, shared, size: int, percent: int) -> DataFrame:
    """(gram, slot, place, key): each set's prefix, rarest first; place is n << 32 | position.
    ``shared`` has the counters, the heavy n-grams with their slots, and the clashing keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (counts, heavy, clashes), seen, shift = shared.value, set(), np.uint64(64 - SKETCH_BITS)
        hot = np.array(sorted(heavy), dtype=np.int64)
        slots = np.array([heavy[g] for g in hot.tolist()], dtype=np.int64)
        for batch in batches:
            grams, places, keys, sizes = [], [], [], []
            for text in batch.column(0).to_pylist():
                s = shingles(text, size)
                if not len(s):
                    continue
                key = node_of(set_key(s), clashes)
                if key in seen:  # a copy in this partition
                    continue
                seen.add(key)
                n = len(s)
                prefix = n - -(-percent * n // 100) + 1
                rare = counts[(s >> shift).astype(np.int64)]
                if prefix < n:
                    near = np.flatnonzero(rare <= np.partition(rare, prefix - 1)[prefix - 1])
                    near = near[np.lexsort((s[near], rare[near]))][:prefix]
                else:
                    near = np.lexsort((s, rare))
                grams.append(s[near].view(np.int64))
                places.append((n << 32) + np.arange(len(near)))
                keys.append(key)
                sizes.append(len(near))
            if len(seen) > 500_000:
                seen.clear()
            if grams:
                gram, key = np.concatenate(grams), np.repeat(np.array(keys, dtype=np.int64), sizes)
                slot = np.zeros(len(gram), dtype=np.int32)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, gram), len(hot) - 1)
                    mine = np.flatnonzero(hot[at] == gram)
                    slot[mine] = 1 + key[mine] % slots[at[mine]]
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(slot), pa.array(np.concatenate(places)), pa.array(key)], names=["gram", "slot", "place", "key"])

    return docs.select("text").mapInArrow(run, "gram long, slot int, place long, key long")


def _live(postings: DataFrame, percent: int) -> DataFrame:
    """Rows of runs in which a neighbour fits by length, with the hub of each: the run's first row that
    fits.  In a slot, which holds a part of its run, all rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.zeros((4, 0), dtype=np.int64)
        last: tuple[int, int, int, int] | None = None  # the last row that went out of sight
        hub: tuple[int, int, int, int] | None = None  # gram, slot, size and key of the present hub

        def settle(rows: np.ndarray, whole: bool) -> pa.RecordBatch | None:
            """All rows but the last, which waits for its successor unless this is the end."""
            nonlocal last, hub, carry
            gram, slot, place, key = rows
            own = np.ones(len(gram), dtype=bool)
            own[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
            if last is not None and len(gram):
                own[0] = (gram[0], key[0]) != (last[0], last[3])
            rows = rows[:, own]
            gram, slot, place, key = rows
            n = place >> 32
            after = np.zeros(len(gram), dtype=bool)
            after[:-1] = (gram[1:] == gram[:-1]) & (slot[1:] == slot[:-1]) & (100 * n[:-1] >= percent * n[1:])
            before = np.zeros(len(gram), dtype=bool)
            before[1:] = after[:-1]
            if last is not None and len(gram):
                before[0] = (gram[0], slot[0]) == last[:2] and 100 * (last[2] >> 32) >= percent * n[0]
            stop = max(len(gram) if whole else len(gram) - 1, 0)
            if stop > 0:
                last = tuple(rows[:, stop - 1].tolist())
            carry = rows[:, stop:]
            at = np.flatnonzero((after | before | (slot > 0))[:stop])
            hubs = []
            for g, p, m, k in zip(gram[at].tolist(), slot[at].tolist(), n[at].tolist(), key[at].tolist()):
                if hub is None or hub[:2] != (g, p) or 100 * hub[2] < percent * m:
                    hub = (g, p, m, k)
                hubs.append(hub[3])
            if not len(at):
                return None
            return pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.array(place[at]), pa.array(key[at]), pa.array(hubs, type=pa.int64())], names=["gram", "place", "key", "hub"])

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            if (out := settle(np.concatenate([carry, rows], axis=1), False)) is not None:
                yield out
        if carry.shape[1] and (out := settle(carry, True)) is not None:
            yield out

    return postings.repartition("gram", "slot").sortWithinPartitions("gram", "slot", "place", "key").mapInArrow(run, "gram long, place long, key long, hub long")


def _sets(docs: DataFrame, clashes: frozenset[int], size: int) -> DataFrame:
    """(key, n, suffix, outline, body) of each set: its size in each of RANGES ranges of hashes, and in
    about one range for OUTLINE members, each at most 255; and the whole set."""

    def held(s: np.ndarray, bits: int) -> bytes:
        return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, seen = RANGES.bit_length() - 1, set()
        for batch in batches:
            keys, sets = [], []
            for text in batch.column(0).to_pylist():
                s = shingles(text, size)
                if len(s) and (key := node_of(set_key(s), clashes)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(s)
            if len(seen) > 500_000:
                seen.clear()
            wide = [held(s, max(least, (len(s) // OUTLINE).bit_length() - 1)) for s in sets]
            bodies = ([held(s, least) for s in sets], wide, [s.tobytes() for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array([len(s) for s in sets], type=pa.int64()), *(pa.array(b, type=pa.binary()) for b in bodies)], names=["key", "n", "suffix", "outline", "body"])

    return docs.select("text").mapInArrow(run, "key long, n long, suffix binary, outline binary, body binary")


def _may_link(n: int, one: bytes, m: int, two: bytes, percent: int) -> bool:
    """By outlines, the finer one folded: what they hold apart bounds what two sets can share."""
    a, b = (np.frombuffer(x, dtype=np.uint8).astype(np.int64) for x in (one, two))
    if len(a) != len(b):
        few = min(len(a), len(b))
        a, b = (x.reshape(few, -1).sum(axis=1) for x in (a, b))
    shared = -(-percent * (n + m) // (100 + percent))
    return int(np.abs(a - b).sum()) <= n + m - 2 * shared


def _do_link(n: int, one: bytes, m: int, two: bytes, percent: int) -> bool:
    """By whole sets."""
    both = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in (one, two)])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if its rows are few; else the join is shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _place(*columns: str) -> Column:
    """The bit of a sieve that stands for these values."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - SIEVE_BITS)


def _sieve(rows: DataFrame, *columns: str) -> np.ndarray:
    """The bits of all rows' values; 2**SIEVE_BITS of them, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << SIEVE_BITS - 3, dtype=np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = bits.reshape(-1, SIEVE_CHUNK)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int32()), pa.array([parts[k].tobytes() for k in some], type=pa.binary())], names=["chunk", "bits"])

    out = np.zeros((1 << SIEVE_BITS - 3) // SIEVE_CHUNK * SIEVE_CHUNK, dtype=np.uint8)
    place = rows.select(_place(*columns).alias("place"))
    for r in place.repartition(F.floor(F.col("place") / (8 * SIEVE_CHUNK))).mapInArrow(run, "chunk int, bits binary").collect():
        out[r.chunk * SIEVE_CHUNK:(r.chunk + 1) * SIEVE_CHUNK] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _may_hold(rows: DataFrame, *columns: str) -> Column:
    """Whether ``rows`` may have the values that a row has in columns so called; where false, they have not."""
    sieve = rows.sparkSession.sparkContext.broadcast(_sieve(rows, *columns))

    @F.pandas_udf("boolean")
    def passes(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((sieve.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return passes(_place(*columns))


def _among(df: DataFrame, rows: DataFrame, many: int, *columns: str) -> DataFrame:
    """The rows of ``df`` whose values ``rows``, which are ``many``, have too."""
    if many > BROADCAST_ROWS:
        df = df.where(_may_hold(rows, *columns))
    return df.join(_few(rows, many), [*columns], "left_semi")


def _not_among(df: DataFrame, rows: DataFrame, many: int, *columns: str) -> DataFrame:
    """The other rows of ``df``, without ``columns``."""
    if many <= BROADCAST_ROWS:
        return df.join(F.broadcast(rows), [*columns], "left_anti").drop(*columns)
    may = _may_hold(rows, *columns)
    return df.where(~may).drop(*columns).union(df.where(may).join(rows, [*columns], "left_anti").drop(*columns))


def _joined(rows: DataFrame, by_key: DataFrame, few: bool) -> DataFrame:
    """Rows with what ``by_key`` has of their node, once each.  A long set has many rows: where the
    join is shuffled, they are dealt over SALTS tasks."""
    if few:
        return rows.join(F.broadcast(by_key), "key")
    salted = by_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def _passing(pairs: DataFrame, many: int, sets: DataFrame, body: str, percent: int, test: Callable[[int, bytes, int, bytes, int], bool]) -> DataFrame:
    """The (hub, key) pairs whose bodies pass the test.  A group is a hub and some of its members,
    about HUB_MEMBERS at most, even if all pairs have one hub; its task holds one batch at a time."""
    salts = -(-many // HUB_MEMBERS) or 1
    spread = pairs.select("hub", "key", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt"))
    hubs = spread.select(F.col("hub").alias("key"), "salt").distinct()
    held = sets.select("key", "n", F.col(body).alias("body"))
    if many > BROADCAST_ROWS:
        held = held.where(_may_hold(pairs.select("key").union(pairs.select("hub")), "key"))
    members = held.join(_few(spread, many), "key").select("hub", "salt", F.lit(1).alias("member"), "key", "n", "body")
    rows = members.union(held.join(_few(hubs, many), "key").select(F.col("key").alias("hub"), "salt", F.lit(0).alias("member"), "key", "n", "body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own_n, own = None, 0, b""
        for batch in batches:
            found = []
            for h, member, key, n, body in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if not member:
                    hub, own_n, own = h, n, body
                elif h == hub and test(own_n, own, n, body, percent):
                    found.append((h, key))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["hub", "key"])

    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member").mapInArrow(run, "hub long, key long")


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str, percent: int) -> DataFrame:
    """The (hub, key) pairs that link.  Outlines, a small part of the sets, are compared first; whole
    sets are shuffled only for what these leave."""
    near = scratch.write(_passing(pairs, pairs.count(), sets, "outline", percent, _may_link), f"{name}-near")
    return scratch.write(_passing(near, near.count(), sets, "body", percent, _do_link), f"{name}-links")


def _crossing(rows: DataFrame, suffixes: DataFrame, few: bool, percent: int, closest: bool) -> DataFrame:
    """Pairs of a run in different components that pass the length, positional and suffix filters;
    ``closest``: of each node, only the one whose ranges differ least.  ``few`` suffixes are sent to
    all tasks, so they are not shuffled with the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, seen = None, set()

        def pairs(gram, place, key, part, suffix) -> pa.RecordBatch | None:
            if not len(gram):
                return None
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            mixed = np.minimum.reduceat(part, first) != np.maximum.reduceat(part, first)
            if not mixed.any():
                return None
            some = np.repeat(mixed, np.diff(first, append=len(gram)))  # rows of runs that hold several parts
            gram, place, key, part, suffix = (x[some] for x in (gram, place, key, part, suffix))
            n, pos = place >> 32, place & 0xFFFFFFFF
            indexed = n - -(-2 * percent * n // (100 + percent)) + 1  # the prefix of a set among larger ones
            at, step, a, b = np.arange(len(gram)), 0, [], []
            best = np.full(len(gram), np.iinfo(np.int64).max)
            while True:
                step += 1
                at = at[at + step < len(gram)]
                other = at + step
                ok = (gram[at] == gram[other]) & (100 * n[at] >= percent * n[other])
                at, other = at[ok], other[ok]  # sorted by size: what fails now fails for later rows too
                if not len(at):
                    break
                ok = (part[at] != part[other]) & ((pos[at] < indexed[at]) | (n[at] == n[other]))
                x, y = at[ok], other[ok]
                if not len(x):
                    continue
                shared = -(-percent * (n[x] + n[y]) // (100 + percent))
                ok = np.minimum(n[x] - pos[x], n[y] - pos[y]) >= shared  # nothing shared before: true in the first run that both are in
                x, y, shared = x[ok], y[ok], shared[ok]
                for k in range(0, len(x), 50_000):
                    p, q = x[k:k + 50_000], y[k:k + 50_000]
                    apart = np.abs(suffix[p].astype(np.int16) - suffix[q]).sum(axis=1)
                    ok = apart <= n[p] + n[q] - 2 * shared[k:k + 50_000]
                    if closest:
                        np.minimum.at(best, p[ok], (apart[ok].astype(np.int64) << 32) + q[ok])
                        np.minimum.at(best, q[ok], (apart[ok].astype(np.int64) << 32) + p[ok])
                    else:
                        a.append(key[p[ok]])
                        b.append(key[q[ok]])
            if closest:
                at = np.flatnonzero(best < np.iinfo(np.int64).max)
                if not len(at):
                    return None
                return pa.RecordBatch.from_arrays([pa.array(key[best[at] & 0xFFFFFFFF]), pa.array(key[at]), pa.array(best[at] >> 32)], names=["hub", "key", "apart"])
            if not a:
                return None
            found = {(min(p, q), max(p, q)) for p, q in zip(np.concatenate(a).tolist(), np.concatenate(b).tolist())} - seen
            if len(seen) > 500_000:
                seen.clear()
            seen.update(found)
            one, two = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(one, type=pa.int64()), pa.array(two, type=pa.int64()), pa.nulls(len(one)).cast(pa.int64())], names=["hub", "key", "apart"])

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            columns.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint8).reshape(-1, RANGES))
            if carry is not None:
                columns = [np.concatenate(x) for x in zip(carry, columns)]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            carry = [c[cut:] for c in columns]
            if cut and (out := pairs(*(c[:cut] for c in columns))) is not None:
                yield out
        if carry is not None and (out := pairs(*carry)) is not None:
            yield out

    dealt = (rows if few else _joined(rows, suffixes, False)).repartition("gram").sortWithinPartitions("gram", "place", "key")
    dealt = dealt.join(F.broadcast(suffixes), "key") if few else dealt  # which keeps the order of the rows
    found = dealt.select("gram", "place", "key", "part", "suffix").mapInArrow(run, "hub long, key long, apart long")
    if closest:
        return found.groupBy("key").agg(F.min(F.struct("apart", "hub")).alias("best")).select(F.col("best.hub").alias("hub"), "key")
    return found.select("hub", "key").distinct()


def _united(parts: DataFrame, many: int, links: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """(key, part) after the links, and how many parts they joined: only links between parts, once per pair of parts, are followed."""
    one, two = (_few(parts.select(F.col("key").alias(k), F.col("part").alias(p)), many) for k, p in (("hub", "a"), ("key", "b")))
    moved = components(links.join(one, "hub").join(two, "key"), "a", "b", scratch, name).withColumnRenamed("node", "part")
    changed = moved.count()
    if not changed:
        return parts, 0
    return scratch.write(parts.join(_few(moved, changed), "part", "left").select("key", F.coalesce("component", "part").alias("part")), f"{name}-all"), changed


def _hot(live: DataFrame) -> DataFrame:
    """(gram, blocks) of the runs above RUN_ROWS."""
    blocks = F.ceil(F.col("c") * 2 / F.greatest(F.lit(RUN_ROWS), F.sqrt("c") * RUN_ROOTS)).cast("int")
    return live.groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") > RUN_ROWS).select("gram", blocks.alias("blocks"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of runs above RUN_ROWS go to every pair of blocks that theirs is in."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode_outer(F.when(F.col("blocks").isNotNull(), F.sequence(F.lit(0), F.col("blocks") - 1))))
    gram = F.when(F.col("blocks").isNull(), F.col("gram")).otherwise(F.xxhash64("gram", F.least("block", "other"), F.greatest("block", "other")))
    return dealt.select(gram.alias("gram"), "place", "key", "part")


def _rid() -> F.Column:
    """What rows are joined back to their texts by, beside the text's hash: rows without an id are not one group."""
    return F.coalesce("doc_id", "hash")


def _scanned(df: DataFrame, scratch: Scratch, size: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, frozenset[int]]:
    """The texts, the stored first pass, its rows of documents (doc_id, hash, n, key), and the clashing keys."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    scanned = scratch.write(_scan(docs, size), "scanned")
    info = scanned.where("chunk is null and gram is null")
    clashes = _clashes(info)
    key = F.when(F.col("key").isin(*clashes), F.col("more")).otherwise(F.col("key")) if clashes else F.col("key")
    return docs, scanned, info.select("doc_id", "hash", "n", key.alias("key")), clashes


def classes(df: DataFrame, scratch: Scratch, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash, n, key) of every row, and (key, part) of the sets that may link: equal parts are one component."""
    docs, scanned, info, clashes = _scanned(df, scratch, size, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast((_sketch(scanned), _heavy(scanned), clashes))
    live = scratch.write(_live(_postings(docs, shared, size, percent), percent), "live")
    shared.unpersist()
    star = live.where("hub <> key").groupBy("key", "hub").agg(F.count("*").alias("c"))
    star = scratch.write(star.groupBy("key").agg(F.max(F.struct("c", "hub")).alias("best")).select(F.col("best.hub").alias("hub"), "key"), "star")
    parts = scratch.write(live.select("key").distinct().withColumn("part", F.col("key")), "nodes")
    many = parts.count()
    few = many <= BROADCAST_ROWS
    chosen = info.join(_few(parts.select("key"), many), "key", "left_semi").groupBy("key").agg(F.min(F.struct(_rid().alias("rid"), "hash")).alias("c")).select("c.rid", "c.hash")
    texts = _among(docs.withColumn("rid", _rid()), scratch.write(chosen, "chosen"), many, "rid", "hash")
    sets = scratch.write(_sets(texts, clashes, size), "sets")
    parts, _ = _united(parts, many, _verified(star, sets, scratch, "star", percent), scratch, "star-parts")
    rows, joined = live.select("gram", "place", "key"), True
    hot = scratch.write(_hot(live), "hot")
    runs = hot.count()
    for turn in range(CLOSEST_ROUNDS + 1):
        closest = joined and turn < CLOSEST_ROUNDS
        name = f"closest-{turn}" if closest else "every"
        dealt = _in_blocks(_joined(rows, parts, few).join(_few(hot, runs), "gram", "left"))
        pairs = scratch.write(_crossing(dealt, sets.select("key", "suffix"), few, percent, closest), f"{name}-pairs")
        if not pairs.count():
            break
        parts, changed = _united(parts, many, _verified(pairs, sets, scratch, name, percent), scratch, f"{name}-parts")
        joined = changed * WORTH >= many
        if not closest:
            break
    parts = scratch.write(parts, "parts")
    scratch.only("scanned", "parts")
    return info, parts


def cluster(df: DataFrame, scratch: Scratch, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id."""
    info, parts = classes(df, scratch, size, percent, id_col, text_col)
    first = info.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    named = first.join(parts, "key", "left").select("key", "first", F.coalesce("part", "key").alias("part"))
    least = named.groupBy("part").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "part").select("key", "component_id")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return info.join(ids, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark, BATCH_ROWS)
    return cluster(table(spark, sf_dir, "documents"), Scratch(spark))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Of each component one document stays with all its columns, whatever their names: the one of
    the least id, and of rows with that id the one whose text has the least hash; rows without an
    id come last.  Rows that repeat id and text become one; null and wordless texts all stay.
    """
    text_batches(spark, BATCH_ROWS)
    scratch = Scratch(spark)
    info, parts = classes(docs, scratch, size, percent)
    named = info.where("key is not null").join(parts, "key", "left").withColumn("part", F.coalesce("part", "key"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    kept = named.groupBy("part", "doc_id", "hash").agg(F.count("*").alias("rows")).groupBy("part").agg(F.min(F.struct(first.alias("first"), "rows")).alias("best"))
    rid, text, own = (fresh(x, docs) for x in ("kept_rid", "kept_text", "kept_rows"))
    kept = kept.select(F.coalesce("best.first.doc_id", "best.first.hash").alias(rid), F.col("best.first.hash").alias(text), F.col("best.rows").alias(own))
    wordless = info.where("key is null").select(_rid().alias(rid), F.col("hash").alias(text), F.lit(1).cast("long").alias(own)).distinct()
    kept = scratch.write(kept.union(wordless), "kept")
    others = named.select(_rid().alias(rid), F.col("hash").alias(text)).distinct().join(kept.where(F.col(own) == 1), [rid, text], "left_anti")
    others = scratch.write(others, "others")
    hashed = docs.withColumns({text: F.xxhash64("text"), rid: F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))})
    out = _not_among(hashed, others, others.count(), rid, text)
    if repeats := kept.where(F.col(own) > 1).count():
        same = _among(hashed, kept.where(F.col(own) > 1), repeats, rid, text)
        out = out.unionByName(same.dropDuplicates([rid, text]).drop(rid, text))
    return out
