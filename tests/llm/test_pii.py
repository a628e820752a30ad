import hashlib
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii
from tests.llm.conftest import DOC_SCHEMA

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    def ok(kind, s):
        digits = [int(c) for c in s if c in "0123456789"]
        if kind == 1:
            return all(int(x) <= 255 for x in s.split("."))
        if kind == 2:
            total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == 0 or 8 <= len(digits) <= 15

    return [[m.span() for m in re.finditer(p, text) if ok(k, m[0])] for k, p in enumerate(PATTERNS)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1234.@+-() 05é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_known():
    t = "a.b@c-d.example, 4111 1111 1111 1111 +49 (30) 1234-567, 10.0.0.255 1.2.3.256 a@b @c.d x@y.z@q.r"
    assert pii.base_spans(t) == brute(t) and [len(x) for x in pii.base_spans(t)] == [2, 1, 1, 1]


def test_long_runs_take_linear_time():
    start = time.process_time()  # quadratic time would be hours
    for run in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "@" * 200_000, "a1_" * 70_000, "+1(" * 70_000, "-" * 200_000):
        pii.spans(run, frozenset({1}))
    assert time.process_time() - start < 60


def test_em_finds_the_reliable_labelers():
    rnd = np.random.default_rng(1)
    truth = rnd.random(4000) < 0.4
    good = np.where(rnd.random((4000, 4)) < 0.9, truth[:, None], ~truth[:, None])
    v = np.hstack([np.where(good, 1, -1), rnd.choice([-1, 0, 1], (4000, 1))])
    post, rate = pii.expectation_maximisation(v, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.95 and rate[1, 0, 2] > 0.8 and abs(rate[1, 4, 2] - rate[0, 4, 2]) < 0.1


def test_operator(spark, docs_rows):
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    rows = [*docs_rows, *((20 + i, f'mail me.{i}@x.example {i} token = "{key[i:]}{key[:i]}" and 2024-01-0{i}-x or word12345{i}', "en", "a", 9) for i in range(9)), (20, None, None, None, None)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    sensitive = pii.train(df)
    got = pii.find(df, sensitive).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id >= 21:
            text = next(x[1] for x in rows if x[0] == r.doc_id)
            want = ",".join(f"{k}:{a}:{b}" for k, s in zip(pii.BASE, brute(text)) for a, b in s)
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.n_email == 1
            assert [text[int(a):int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",")) if k == "secret"] == [key[r.doc_id - 20:] + key[:r.doc_id - 20]]
    out = {r.doc_id: r for r in pii.redact(df.where("doc_id <> 20")).collect()}
    assert out[2].text is None and out[3].text == "" and out[1].text == docs_rows[0][1] and out[1].n_chars == 3
    assert out[25].text.startswith('mail [EMAIL] 5 token = "[SECRET]"') and out[25].n_chars == len(out[25].text)
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert pii.find(empty, pii.train(empty)).count() == 0
