import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from tessera.llm import byte_bpe
from tests.llm.conftest import DOC_SCHEMA

PATH = P.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_the_library(spark, docs_rows):
    lib = library()
    rnd = random.Random(5)
    more = [(100 + i, "".join(rnd.choice("abcdeé ,.\n'st1") for _ in range(rnd.randint(1, 300))), "en", "a", 1) for i in range(60)]
    rows = docs_rows + more
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    got = {r.doc_id: r for r in byte_bpe.round_trip(df, PATH, P.PATTERN).collect()}
    ids = {r.doc_id: r.ids for r in byte_bpe.encode(df, PATH, P.PATTERN).collect()}
    for doc_id, text, *_ in rows:
        want = lib.encode_ordinary(text or "")
        assert ids[doc_id] == want
        assert got[doc_id].n_tokens == len(want)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert {r.doc_id: bytes(r.bytes) for r in back.collect()} == {r[0]: (r[1] or "").encode() for r in rows}


def test_empty_table(spark):
    assert byte_bpe.round_trip(spark.createDataFrame([], DOC_SCHEMA), PATH, P.PATTERN).count() == 0
