"""Memoised encoding of whole texts by chunks at which every pre-tokenizer match ends.

A single space or line feed between two characters that are not white space always starts a new
match of the byte-level pattern: no alternative crosses it, ``\\s+(?!\\S)`` cannot match one lone
white space before a character, and a leading space belongs to what follows.  So a text whose
white space is only such lone characters is cut there, and what a chunk encodes to is looked up,
once for each distinct chunk of a batch; Arrow finds those and puts their ids in place.
Any other text is encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept by a worker; beyond it the memo starts anew, so its memory is bounded.
MEMO_CHUNKS = 800_000


#: All that Python holds for white space, some of which the pattern does not; so more is encoded whole, never less.
SPACES = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
#: Found in a text that is encoded whole: white space at either end, of two characters, or other than a space or line feed.
NOT_LONE = rf"\A[{SPACES}]|[{SPACES}][{SPACES}]|[{SPACES.replace(' ', '').replace(chr(10), '')}]|[{SPACES}]\z"


def split(texts: list[str | None]) -> list[tuple[str, str | None] | None]:
    """The first chunk of each and, parted by spaces, the others without their leading space (those after a line feed keep it);
    None: encode it whole."""
    whole = pc.match_substring_regex(pa.array(texts, type=pa.large_string()), NOT_LONE).to_pylist()
    parts = [t.replace("\n", " \n").partition(" ") if t and not w else None for t, w in zip(texts, whole)]
    return [p and (p[0], p[2] if p[1] else None) for p in parts]


class ChunkMemo:
    """Encodes texts to little-endian uint32 ids by ``encode_all``, which maps strings to ids as bytes."""

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]], limit: int = MEMO_CHUNKS):
        self.encode_all, self.limit = encode_all, limit
        self.memo: dict[str, bytes] = {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.memo) > self.limit:
            self.memo.clear()
        parts = split(texts)
        lists = pc.split_pattern(pa.array([p[1] if p else None for p in parts], type=pa.large_string()), " ")
        flat = lists.flatten().dictionary_encode()
        one = pa.ListArray.from_arrays([0, len(flat.dictionary)], flat.dictionary)
        chunks = pc.binary_join(one, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(flat) else []
        coded = list(map(self.memo.get, chunks))
        new = [c for c, x in zip(chunks, coded) if x is None]
        firsts = [p[0] if p else t for t, p in zip(texts, parts) if t]  # of a text that is encoded whole, all of it
        coded_new = self.encode_all([c if c[0] == "\n" else " " + c for c in new] + firsts)
        self.memo.update(zip(new, coded_new))
        fresh, rest = iter(coded_new), iter(coded_new[len(new):])
        placed = pa.array([next(fresh) if x is None else x for x in coded], type=pa.large_binary()).take(flat.indices)
        _, stops, data = placed.buffers()
        stops, data = memoryview(stops or bytes(8)).cast("B").cast("q"), memoryview(data or b"")
        ends = [stops[k] for k in lists.offsets.to_pylist()]
        return [next(rest) + data[a:b] if t else b"" for t, a, b in zip(texts, ends, ends[1:])]
