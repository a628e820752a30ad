"""Encoding by the tokenizers library, shared by the token files and the packer.

Lone words go straight to the library's BPE model (in its byte alphabet), anything else through
its whole pipeline; chunks are memoised (see ``chunks``).  Tests hold this against encoding whole
texts by the library.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

from tessera.llm.chunks import ChunkMemo


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and up in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class LibraryEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task is what Spark counts on
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.alphabet = byte_alphabet()
        self.stops = {c: array("I", self.tokenizer.encode(c, add_special_tokens=False).ids).tobytes() for c in ".,"}

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        tokenize, alphabet, others = self.tokenizer.model.tokenize, self.alphabet, []
        space = alphabet[0x20]
        for k, t in enumerate(texts):
            word, stop = (t[:-1], self.stops[t[-1]]) if t[-1] in ".," else (t, b"")
            if word[1:].isalpha() and word[0] == " ":
                spelled = space + word[1:] if word.isascii() else word.encode().decode("latin-1").translate(alphabet)
                out[k] = array("I", [x.id for x in tokenize(spelled)]).tobytes() + stop
            else:
                others.append(k)
        for k, coded in zip(others, self.tokenizer.encode_batch_fast([texts[k] for k in others], add_special_tokens=False)):
            out[k] = array("I", coded.ids).tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkMemo:
    """Of a worker: maps texts to their ids as little-endian uint32."""
    return ChunkMemo(LibraryEncoder(path).encode_all)
