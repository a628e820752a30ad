"""Personal data: fixed patterns, and spans found by aggregating weak labelers.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stay.  The method
adds spans of the kinds in MORE.  Candidates are runs of identifier characters with a digit; labelers
vote on each (sensitive, not, or no opinion): regexes for shapes, gazetteers of issuers' prefixes
and country codes, checks of characters, and words of the context.  How often each pattern of
votes occurs in all documents is counted; expectation maximisation on these counts estimates how
reliable each labeler is; the posteriors train a logistic span classifier on the votes and on
shape features, and it decides every candidate.  Votes and features take few values, so the
counts are a table of bounded size however many documents there are.

Null and empty texts have no spans.  Repeated rows are handled each by itself; other columns are
not read.  Without candidates nothing is fitted and only base spans are found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_batches

BASE = ("email", "ip", "card", "phone")
MORE = ("secret", "iban", "national_id")
Span = tuple[int, int]

# A match never starts inside a run that an earlier try failed on, so the look-behinds change no
# match but keep long runs from being scanned again from each of their characters.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z0-9_/+=-]{9})[A-Za-z_/+=-]*+[0-9][A-Za-z0-9_/+=-]*+")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(int(d) if k % 2 == 0 else twice[int(d)] for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[list[Span]]:
    """Spans of each base kind, leftmost first."""
    email: list[Span] = []
    end = 0
    for m in _AT.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            email.append((start, m.end()))
            end = m.end()
    if not _DIGIT.search(text):
        return [email, [], [], []]
    ip = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in m.groups())]
    card = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                card.append(m.span())
    phone = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return [email, ip, card, phone]


# Gazetteers: prefixes that issuers give their keys, and IBAN country codes with lengths.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "sk-", "sk_live_", "pk_live_", "rk_live_", "AIza", "eyJ", "glpat-", "npm_", "SG.")
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
CONTEXT = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_ -]?key|apikey|access[_ -]?key|auth|bearer|credential|private|iban|account|konto|cuenta|compte|ssn|social security|passport|tax id|national id)\b[^\n]{0,12}\Z")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\Z")
_HEX = re.compile(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})\Z")
_ASSIGNED = re.compile(r"[=:]\s?[\"']?\Z")


def _iban(word: str) -> bool:
    if IBAN_LENGTHS.get(word[:2]) != len(word) or not word[2:4].isdigit() or not word.isalnum() or not word.isupper():
        return False
    return int("".join(str(int(c, 36)) for c in word[4:] + word[:4])) % 97 == 1


def kind_of(word: str) -> int:
    return 1 if word[:2] in IBAN_LENGTHS and word[2:4].isdigit() and word.isalnum() and len(word) >= 15 else 2 if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", word) else 0


def votes(word: str, before: str) -> tuple[int, ...]:
    """1 sensitive, -1 not, 0 no opinion, from each labeler."""
    classes = sum(map(bool, (re.search("[a-z]", word), re.search("[A-Z]", word), re.search("[0-9]", word))))
    distinct = len(set(word)) / min(len(word), 40)
    return (
        1 if _HEX.match(word) or _SSN.match(word) or _iban(word) else -1 if word.isdigit() or re.fullmatch(r"[0-9-]+", word) else 0,
        1 if word.startswith(KEY_PREFIXES) else 1 if IBAN_LENGTHS.get(word[:2]) == len(word) else 0,
        1 if CONTEXT.search(before) else 0,
        1 if classes >= 2 and len(word) >= 20 and distinct >= 0.3 else -1 if len(word) < 12 or distinct < 0.2 else 0,
        1 if _ASSIGNED.search(before) else -1 if before[-1:].isspace() and len(word) < 16 else 0,
    )


LABELERS = 5


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, code): the code spells the votes and shape features."""
    if not _DIGIT.search(text):
        return []
    found = []
    for m in _CANDIDATE.finditer(text):
        word, start = m[0], m.start()
        v = votes(word, text[max(0, start - 40):start])
        digits = sum(map(word.count, "0123456789")) / len(word)
        code = reduce(lambda c, x: 3 * c + x + 1, v, kind_of(word))
        code = 16 * code + 4 * min(3, len(word) // 12) + min(3, int(4 * digits))
        found.append((start, m.end(), kind_of(word), code))
    return found


def _decode(code: int) -> tuple[int, list[int], int, int]:
    code, shape = divmod(code, 16)
    v = []
    for _ in range(LABELERS):
        code, x = divmod(code, 3)
        v.append(x - 1)
    return code, v[::-1], shape // 4, shape % 4


def expectation_maximisation(v: np.ndarray, n: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "sensitive" for each row of votes, seen n times, and P(vote | class) per labeler."""
    post = 1 / (1 + np.exp(-1.5 * v.sum(axis=1)))
    hot = v[:, :, None] == np.array([-1, 0, 1])
    for _ in range(rounds):
        w = np.stack([1 - post, post]) * n
        rate = np.einsum("cr,rlv->clv", w, hot) + 0.5
        rate /= rate.sum(axis=2, keepdims=True)
        share = (w.sum(axis=1) + 1) / (n.sum() + 2)
        log = np.einsum("clv,rlv->cr", np.log(rate), hot) + np.log(share)[:, None]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
    return post, rate


def _features(code: int) -> np.ndarray:
    kind, v, length, digits = _decode(code)
    x = np.zeros(1 + 3 + 3 * LABELERS + 4 + 4)
    x[[0, 1 + kind, *(4 + 3 * k + vote + 1 for k, vote in enumerate(v)), 4 + 3 * LABELERS + length, 8 + 3 * LABELERS + digits]] = 1
    return x


def fit(counts: dict[int, int]) -> frozenset[int]:
    """The codes that the trained classifier calls sensitive."""
    if not counts:
        return frozenset()
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], dtype=float)
    post, _ = expectation_maximisation(np.array([_decode(c)[1] for c in codes]), n)
    x = np.array([_features(c) for c in codes])
    w, weight = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(30):  # Newton on the logistic loss with soft labels and a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - post)) + 1e-3 * w
        hess = (x.T * (weight * p * (1 - p))) @ x + 1e-3 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hess, grad), -3, 3)
    return frozenset(c for c, s in zip(codes, x @ w) if s > 0)


def train(docs: DataFrame, text_col: str = "text") -> frozenset[int]:
    """Counts the codes of all documents' candidates, then fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for *_, code in candidates(text or ""):
                    counts[code] = counts.get(code, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.int32()), pa.array(list(counts.values()), type=pa.int64())], names=["code", "n"])

    rows = docs.select(text_col).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return fit({r.code: r.n for r in rows})


def spans(text: str, sensitive: frozenset[int]) -> list[list[Span]]:
    """Spans by kind, BASE then MORE; added ones never overlap base ones."""
    found = base_spans(text)
    taken = sorted(s for kind in found for s in kind)
    more: list[list[Span]] = [[] for _ in MORE]
    at, reach = 0, 0
    for a, b, kind, code in candidates(text) if sensitive else ():
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= a and code in sensitive:
            more[kind].append((a, b))
    return found + more


def find(docs: DataFrame, sensitive: frozenset[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, counts of base kinds, a digest of the base spans, and all spans as text."""

    def spell(kinds: tuple[str, ...], found: list[list[Span]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, own in zip(kinds, found) for a, b in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(t or "", sensitive) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([len(f[k]) for f in found], type=pa.int64()) for k in range(4)),
                 pa.array([hashlib.sha256(spell(BASE, f).encode()).hexdigest() for f in found], type=pa.string()), pa.array([spell(BASE + MORE, f) for f in found], type=pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, sensitive: frozenset[int]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first names all."""
    found = sorted((a, b, k) for k, own in zip(BASE + MORE, spans(text, sensitive)) for a, b in own)
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if found else text


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, the texts masked and n_chars, where there is one, as the texts then are.

    Null and empty texts, and texts without spans, stay as they are, with their n_chars; an empty table stays empty.
    """
    sensitive, at = train(docs), docs.columns.index("text")
    n = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = list(batch.columns), batch.column(at).to_pylist()
            out = [t and masked(t, sensitive) for t in texts]
            columns[at] = pa.array(out, type=pa.string())
            if n is not None:
                columns[n] = pa.array([c if x == t else len(x) for c, x, t in zip(columns[n].to_pylist(), out, texts)], type=columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs))
