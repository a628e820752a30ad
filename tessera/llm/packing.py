"""Best-fit packing of documents into sequences by bin completion.

Packing depends only on how many pieces have each length, a table of at most ``capacity`` counts
whatever the number of documents.  ``solve`` searches it depth first.  A node fills bins around the
longest piece left: it enumerates fillings of the rest of the bin, fullest first, none dominated by
swapping a member for a longer piece that still fits; a branch gives a filling to several bins at
once, at first to half of those that the counts allow (a supply of many lengths is what makes later
bins full), last to single ones, so no solution is out of reach.  A node goes when the bins so far
and the least that the rest needs, which is the waste that a better solution may still have, do not
beat the incumbent, or when the same pieces were left before with as few bins.  The best-fit solution is the first
incumbent; the search ends at the lower bound on the number of bins, which is then optimal, or after
STEPS steps beyond its first descent for each of two orders of branches, with the best found by then.

Pieces then get their places by rank among the pieces of their length: counts per (length, file
partition) give every partition its first rank, so no task ever holds all pieces of one length.

A null or empty text is the end id alone.  Only documents longer than ``capacity`` are cut, the
first piece taking what is left over.  Repeated rows and ids are packed each by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table, text_batches
from tessera.llm.tokens import encoder

CAPACITY = 2048
#: Fillings compared at each node, and steps of their enumeration.
FILLINGS = 12
FILL_STEPS = 400
#: Steps of all enumerations beyond the first descent, for each order of branches; a node itself counts as NODE_STEPS.
STEPS, NODE_STEPS = 60_000, 5

Pattern = tuple[tuple[int, int], ...]  # (length, copies)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """At least this many bins: by sum, and by pieces too long to share one with those of k and more."""
    lengths, half = np.arange(len(counts)), capacity // 2
    below, mass = np.cumsum(counts), np.cumsum(counts * lengths)
    k = np.arange(half + 1)
    mid = below[capacity - k] - below[half]
    small = mass[half] - np.where(k > 0, mass[k - 1], 0)
    room = mid * capacity - (mass[capacity - k] - mass[half])
    needed = below[capacity] - below[half] + np.maximum(0, -((room - small) // capacity))
    return max(-(-int(mass[-1]) // capacity), int(needed.max()))


def _fillings(counts: np.ndarray, room: int, most: int) -> tuple[list[tuple[int, ...]], int]:
    """Undominated sets of available lengths of at most ``room`` in sum, fullest first; and the steps that it took."""
    found: dict[tuple[int, ...], int] = {}
    left = counts[:room + 1].copy()
    left[0] = 0
    steps, full = FILL_STEPS, 0

    def fullest_pair(space: int) -> tuple[int, ...]:
        lengths = np.flatnonzero(left[:space + 1])
        if not len(lengths):
            return ()
        partner = np.searchsorted(lengths, space - lengths, side="right") - 1
        ok = partner >= 0
        same = ok & (partner == np.arange(len(lengths))) & (left[lengths] < 2)
        partner = np.where(same, partner - 1, partner)
        total = lengths + np.where(partner >= 0, lengths[np.maximum(partner, 0)], 0)
        k = int(total.argmax())
        pair = (int(lengths[k]), int(lengths[partner[k]])) if partner[k] >= 0 else (int(lengths[k]),)
        return tuple(sorted(pair, reverse=True)) if sum(pair) > lengths[-1] else (int(lengths[-1]),)

    def search(space: int, top: int, chosen: tuple[int, ...]) -> None:
        nonlocal steps, full
        steps -= 1
        last = fullest_pair(min(space, len(left) - 1))
        total = tuple(sorted(chosen + last, reverse=True))
        if total not in found:
            found[total] = sum(total)
            full += found[total] == room
        if steps <= 0 or full >= most:
            return
        for length in np.flatnonzero(left[:min(space, top) + 1])[::-1].tolist():
            left[length] -= 1
            if space - length > 0:
                search(space - length, length, (*chosen, length))
            left[length] += 1
            if steps <= 0 or full >= most:
                return

    search(room, room, ())

    def dominated(filling: tuple[int, ...]) -> bool:
        slack = room - sum(filling)
        if not slack:
            return False
        for length in {0, *filling}:
            better = left[length + 1:length + slack + 1].copy()
            for other in filling:
                if length < other <= length + slack:
                    better[other - length - 1] -= 1
            if (better > 0).any():
                return True
        return False

    kept = sorted((f for f in found if not dominated(f)), key=lambda f: (-sum(f), len(f), [-x for x in f]))
    return kept[:most] or [max(found, key=sum)], FILL_STEPS - steps


def _times(counts: np.ndarray, pieces: tuple[int, ...]) -> int:
    need = np.bincount(pieces)
    at = np.flatnonzero(need)
    return int((counts[at] // need[at]).min())


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The longest piece that fits goes in, again and again."""
    counts, bins = counts.copy(), []
    while counts.any():
        room, chosen, left = capacity, [], counts.copy()
        while room > 0 and len(fit := np.flatnonzero(left[:room + 1])):
            length = int(fit[-1])
            n = min(int(left[length]), room // length)
            chosen += [length] * n
            left[length] -= n
            room -= n * length
        times = _times(counts, tuple(chosen))
        counts = counts - np.bincount(chosen, minlength=len(counts)) * times
        bins.append((tuple(chosen), times))
    return bins


class _Search:
    """One depth-first search over a table of counts for at most ``target`` bins, and then for fewer."""

    def __init__(self, counts: np.ndarray, capacity: int, target: int, limit: int, share: int):
        self.left, self.capacity, self.target, self.limit, self.share = counts.copy(), capacity, target, limit, share
        self.rest = int((counts * np.arange(len(counts))).sum())
        self.used, self.steps, self.ended = 0, STEPS, False
        self.bins: list[tuple[tuple[int, ...], int]] = []
        self.best: list[tuple[tuple[int, ...], int]] | None = None
        self.seen: dict[int, int] = {}

    def _branches(self) -> Iterator[tuple[tuple[int, ...], int]]:
        """The first full filling, then, when the search comes back, all others and other numbers of bins."""
        longest = int(np.flatnonzero(self.left)[-1])
        first = self._picks(longest, 1)[0]
        yield first[0], max(1, first[1] // self.share)
        picks = self._picks(longest, FILLINGS)
        yield from ((p, max(1, t // self.share)) for p, t in picks if p != first[0])
        for p, t in picks:
            n = t
            while n >= 1:
                if n != max(1, t // self.share):
                    yield p, n
                n //= 2

    def _picks(self, longest: int, most: int) -> list[tuple[tuple[int, ...], int]]:
        self.left[longest] -= 1
        fillings, steps = _fillings(self.left, self.capacity - longest, most)
        self.left[longest] += 1
        self.steps -= steps * self.ended
        return [((longest, *f), _times(self.left, (longest, *f))) for f in fillings]

    def _put(self, pieces: tuple[int, ...], times: int) -> None:
        """``times`` bins of these pieces; a negative number takes them back."""
        np.subtract.at(self.left, list(pieces), times)
        self.rest -= sum(pieces) * times
        self.used += times

    def _open(self) -> bool:
        """If what is left may still make a solution that counts."""
        if self.used + lower_bound(self.left, self.capacity) > self.target:
            return False
        state = hash(self.left.tobytes())
        if self.seen.get(state, self.used + 1) <= self.used:
            return False
        self.seen[state] = self.used
        return True

    def run(self) -> list[tuple[tuple[int, ...], int]] | None:
        stack = [self._branches()]
        while stack and self.steps > 0:
            branch = next(stack[-1], None)
            if branch is None:
                stack.pop()
                if self.bins:
                    pieces, times = self.bins.pop()
                    self._put(pieces, -times)
                continue
            self.steps -= NODE_STEPS * self.ended
            self._put(*branch)
            if self.rest and self._open():
                self.bins.append(branch)
                stack.append(self._branches())
                continue
            self.ended = True
            if not self.rest and self.used <= self.target:
                self.best, self.target = [*self.bins, branch], self.used - 1
                if self.used <= self.limit:
                    break
            self._put(branch[0], -branch[1])
        return self.best


def searched(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], bool]:
    """Bins, and if the search found them; else they are the first incumbent."""
    counts = np.asarray(counts, dtype=np.int64).copy()
    counts[0] = 0
    best, found, limit = _best_fit(counts, capacity), False, lower_bound(counts, capacity)
    if not counts.any():
        return best, found
    for share in (2, 1):
        many = sum(t for _, t in best)
        if better := _Search(counts, capacity, max(limit, many - 1), limit, share).run():
            best, found = better, True
        if sum(t for _, t in best) <= limit and found:
            break
    return best, found


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Fillings and how many bins get each; ``counts[n]`` pieces have length n, 1 to capacity."""
    bins, _ = searched(counts, capacity)
    merged: dict[Pattern, int] = {}
    for pieces, times in bins:
        need = np.bincount(pieces)
        pattern = tuple((n, int(need[n])) for n in np.flatnonzero(need)[::-1].tolist())
        merged[pattern] = merged.get(pattern, 0) + times
    return list(merged.items())


def places(bins: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Rows that give the pieces of one length from rank ``first`` on their bins and offsets."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in bins:
        offset = 0
        for length, copies in pattern:
            rows.append((length, used.get(length, 0), sequence, times, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * copies
        sequence += times
    columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "sequence", "times", "offset"), columns))


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """A row per piece, numbered among those of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, seen = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), {}
        for batch in batches:
            rows = []
            for doc_id, coded in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                coded += end
                n = len(coded) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    nth = seen[b - a] = seen.get(b - a, -1) + 1
                    rows.append((doc_id, k, a, b - a, zlib.crc32(coded[4 * a:4 * b]), nth))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long").withColumn("part", F.spark_partition_id())


def pack(df: DataFrame, tokenizer: str, scratch: Scratch, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = scratch.write(_pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity rows
        counts[r.length] = r.n
    plan = places(solve(counts, capacity))
    # counted anew rather than stored: a file for each shuffle partition costs more than two narrow columns read twice
    held = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = held.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    # a row per length and file, which grows with the table: never sent to the driver or to all executors
    ranked = pieces.join(before.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = int(counts.max()) + 1
        keys = plan["length"] * wide + plan["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            nth = rank - plan["first"][at]
            sequence = plan["sequence"][at] + nth % plan["times"][at]
            offset = plan["offset"][at] + length * (nth // plan["times"][at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    text_batches(spark)
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), Scratch(spark))
