import random
import zlib
from functools import partial

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from tessera.llm import token_files
from tessera.llm.chunks import ChunkMemo, split
from tessera.llm.common import Scratch, gathered, text_batches
from tessera.llm.tokens import LibraryEncoder
from tests.llm.conftest import DOC_SCHEMA

PATH = P.path("byte_bpe_50k.json")


def library(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_files_hold_what_the_library_encodes(spark, docs_rows):
    rows = [*docs_rows, (None, "no id", "en", "a", 1), (None, "none here either", "en", "a", 1), (4, "again the same id", None, None, None)]
    scratch = Scratch(spark)
    token_files.write(spark.createDataFrame(rows, DOC_SCHEMA).repartition(3), scratch.path("t"), PATH)
    stored = token_files.read(spark, scratch.path("t"))
    out = token_files.with_start(token_files.digests(stored), ["doc_id", "n_tokens", "ids_crc32"]).orderBy("start").collect()
    start = 0
    hashed = {r.text: r.h for r in spark.createDataFrame(rows, DOC_SCHEMA).selectExpr("text", "xxhash64(text) AS h").collect()}
    for r, (doc_id, text, *_) in zip(out, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hashed[x[1]]))):
        ids = [*library(text), 0]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert len(out) == len(rows)
    one = token_files.read(spark, scratch.path("t"), [6])
    assert [x.ids for x in one.collect()] == [[*library(docs_rows[5][1]), 0]]
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id" in one._jdf.queryExecution().toString()
    scratch.drop()


def test_empty_table(spark):
    scratch = Scratch(spark)
    token_files.write(spark.createDataFrame([], DOC_SCHEMA), scratch.path("t"), PATH)
    assert token_files.with_start(token_files.digests(token_files.read(spark, scratch.path("t"))), ["doc_id"]).count() == 0
    scratch.drop()


def test_distinct_chunks_of_a_batch_are_looked_up_once():
    """However often they occur; before, every word of a text was."""

    class Counting(dict):
        looked = 0

        def get(self, *args):
            Counting.looked += 1
            return super().get(*args)

    memo = ChunkMemo(lambda texts: [t.encode("utf-32-le") for t in texts])
    memo.memo = Counting()
    text = "first " + "word another\nline " * 1000 + "last"
    for _ in range(2):
        Counting.looked = 0
        assert memo([text, None, text]) == [text.encode("utf-32-le"), b"", text.encode("utf-32-le")]
        assert Counting.looked <= 8


def test_small_batches_are_encoded_together(spark, monkeypatch):
    """Neighbours up to a bound; before, each Arrow batch was encoded by itself, with its words looked up anew."""
    assert [b.num_rows for b in gathered(iter([pa.RecordBatch.from_pydict({"x": pa.array([0] * n, pa.int64())}) for n in (2, 3, 9, 1, 0, 1)]), 40)] == [5, 9, 2]
    assert list(gathered(iter([]))) == []
    text_batches(spark, 1)
    texts = ["one more time", None, "", "again  one", "\u6f22 more\ntime", "last"]
    for size in (1, 1 << 20):
        monkeypatch.setattr(token_files, "gathered", partial(gathered, limit=size))
        scratch = Scratch(spark)
        token_files.write(spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOC_SCHEMA), scratch.path("t"), PATH)
        stored = token_files.with_start(token_files.read(spark, scratch.path("t")), ["doc_id", "ids"]).orderBy("doc_id").collect()
        assert [list(r.ids) for r in stored] == [[*library(t), 0] for t in texts]
        assert [r.start for r in stored] == [sum(len(library(t)) + 1 for t in texts[:k]) for k in range(len(texts))]
        scratch.drop()
    text_batches(spark)


def test_only_texts_with_lone_spaces_and_line_feeds_are_cut():
    """As comparing their words one by one decides, which is what found them before."""
    rnd = random.Random(3)
    marks = ["a", "\u6f22", ".", "\u180e", "\u200b", " ", " ", "\n", *filter(str.isspace, map(chr, range(0x3001)))]
    texts = ["".join(rnd.choice(marks[:rnd.choice([8, 37])]) for _ in range(rnd.randrange(12))) for _ in range(5000)]
    texts += [a + s + b for s in marks for a in ("", "a", " ") for b in ("", "a", "\n")]
    cut = [p is not None for p in split([None, *texts])]
    assert cut == [False, *(bool(t) and " ".join(t.split()) == t.replace("\n", " ") for t in texts)]
    assert 200 < sum(cut) < 5000


def test_chunks_of_any_batch_as_the_library():
    rnd, coder = random.Random(7), LibraryEncoder(PATH)
    parts = ["word", "Über.", "don't", "3.14", "\u6f22\u5b57,", "a", "<|endoftext|>", "x.", "...", "\x85", "\xa0y", "\x1cz"]
    texts = [None, "", " ", "\n", "one", " lead", "trail ", "trail\n", "a  b", "a \nb", "a\n\nb"]
    texts += ["".join(rnd.choice(parts) + rnd.choice([" ", " ", " ", "\n", "\t", "  "][:rnd.choice([3, 4, 4, 6])]) for _ in range(rnd.randrange(1, 30))) + "end" for _ in range(49)]
    want = {t: np.array(library(t), dtype="<u4").tobytes() for t in set(texts)}
    for limit in (0, 5, 10**6):
        memo = ChunkMemo(coder.encode_all, limit)
        for batch in ([], [None], [None, ""], ["one"], texts, texts[:11], texts[11:], texts[::-1]):
            assert memo(batch) == [want[t] for t in batch]
