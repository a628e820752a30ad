"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

Each leaf of the tree is a byte position and holds the merge rank of the pair that starts there;
each inner node holds the leftmost minimum below it, so the root names the next merge.  A merge
changes at most three leaves (the pair's own, its dead right part's and its live left
neighbour's), each by a point update along one path to the root.  A piece of n bytes takes
O(n log n) whatever its merges are.  Many short pieces of one padded width are merged side by side
as rows of numpy arrays; a long piece gets a tree of its own.

Null and empty texts have no tokens.  Rows, ties and extra columns do not matter: each row is
encoded on its own and only the two named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.chunks import ChunkMemo
from tessera.llm.common import table, text_batches

#: Above this many bytes a piece gets a tree of its own.
WIDE = 64
#: Pieces merged side by side at most.
ROWS = 2048
#: Above every rank; times WIDE it still fits the int32 nodes of the trees.
_NONE = 1 << 24


class SegmentTreeBpe:
    """BPE by ranks, as the rank files of tiktoken hold them; ``pattern`` cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        size = max(ranks.values(), default=0) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.tokens[i] = token
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self.base = size + 1
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> SegmentTreeBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, _NONE where there is none or an id is below 0."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], _NONE)

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """All pieces have 2 to ``width`` bytes, a power of two."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        place = np.arange(width, dtype=np.int32)
        live = place < lengths[:, None]
        ids = np.full((n, width + 1), -1, dtype=np.int64)  # the last column stands for "no neighbour"
        ids[:, :width] = np.where(live, self.byte_ids[raw], -1)
        after = np.broadcast_to(place + 1, (n, width)).copy()
        after[after >= lengths[:, None]] = width
        before = np.full((n, width + 1), width, dtype=np.int64)
        before[:, 1:width] = place[:-1]
        tree = np.full((n, 2 * width), _NONE * width, dtype=np.int32)
        tree[:, width:] = self._pair_ranks(ids[:, :width], ids[:, 1:]) * width + place
        step = width
        while step > 1:
            half = step // 2
            tree[:, half:step] = np.minimum(tree[:, step:2 * step:2], tree[:, step + 1:2 * step:2])
            step = half
        rows = np.flatnonzero(tree[:, 1] < _NONE * width)
        while len(rows):
            best = tree[rows, 1]
            at, rank = best % width, best // width
            gone = after[rows, at]
            right = np.where(gone < width, after[rows, np.minimum(gone, width - 1)], width)
            left = before[rows, at]
            ids[rows, at] = rank
            ids[rows, gone] = -1
            after[rows, at] = right
            before[rows, right] = at  # column width takes what has no right neighbour
            before[rows, width] = width
            has = left < width
            changes = (
                (rows, at, self._pair_ranks(rank, ids[rows, right]) * width + at),
                (rows, gone, np.full(len(rows), _NONE * width, dtype=np.int32)),
                (rows[has], left[has], self._pair_ranks(ids[rows, left], rank)[has] * width + left[has]),
            )
            for r, leaf, value in changes:
                node = leaf + width
                tree[r, node] = value
                node = node >> 1
                while len(r) and node[0] >= 1:
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] < _NONE * width]
        kept = ids[:, :width] >= 0
        flat = ids[:, :width][kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merge_one(self, piece: bytes) -> bytes:
        """One long piece."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        get, base, none = self.pairs.get, self.base, _NONE * width
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))

        def leaf(i: int, j: int) -> int:
            rank = get(ids[i] * base + ids[j]) if j >= 0 else None
            return none if rank is None else rank * width + i

        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = leaf(i, i + 1)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                value = a if a <= b else b
                if tree[k] == value:
                    return
                tree[k] = value
                k >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            right = after[gone]
            ids[at], ids[gone] = rank, -1
            after[at] = right
            if right >= 0:
                before[right] = at
            put(gone, none)
            put(at, leaf(at, right))
            if before[at] >= 0:
                put(before[at], leaf(before[at], at))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as little-endian uint32; a piece that is a token is that token."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(p) > WIDE:
                out[k] = self._merge_one(p)
            elif p:
                by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(k)
        for width, places in by_width.items():
            for i in range(0, len(places), ROWS):
                some = places[i:i + ROWS]
                for k, coded in zip(some, self._merge_rows([pieces[k] for k in some], width)):
                    out[k] = coded
        return out

    def _cut(self, text: str) -> list[str]:
        """The matches of the pattern; a word of letters, perhaps with a stop or comma, needs no search."""
        if text[1:].isalpha() and text[0] == " ":
            return [text]
        if text[1:-1].isalpha() and text[0] == " " and text[-1] in ".,":
            return [text[:-1], text[-1]]
        return self.pattern.findall(text)

    def encode_strings(self, texts: list[str]) -> list[bytes]:
        """Ids of whole strings, each match of the pattern merged by itself."""
        found = [self._cut(t) for t in texts]
        distinct = list({p for f in found for p in f})
        coded = dict(zip(distinct, self.encode_pieces([p.encode() for p in distinct])))
        return [b"".join(map(coded.__getitem__, f)) for f in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> tuple[SegmentTreeBpe, ChunkMemo]:
    bpe = SegmentTreeBpe.from_file(path, pattern)
    return bpe, ChunkMemo(bpe.encode_strings)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id and ``ids`` array<int>; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _codec(path, pattern)[1]
        for batch in batches:
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in memo(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``df``: the id and ``bytes`` binary; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _codec(path, pattern)[0]
        for batch in batches:
            data = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, type=pa.binary())], names=[id_col, "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text and decodes its ids again; digests of both, so no ids leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo = _codec(path, pattern)
        names = [str(i) for i in range(len(bpe.tokens))]
        for batch in batches:
            counts, spelled, decoded = [], [], []
            for coded in memo(batch.column(1).to_pylist()):
                ids = np.frombuffer(coded, dtype="<u4").tolist()
                counts.append(len(ids))
                spelled.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.int64()), pa.array(spelled, type=pa.string()), pa.array(decoded, type=pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    text_batches(spark)
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
