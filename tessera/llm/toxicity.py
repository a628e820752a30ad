"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its hashed character n-grams and of itself, a window of
WINDOW words the mean of its words, and a linear softmax on it says toxic or not; embeddings and
softmax are trained jointly in numpy.  A word above LONGEST characters is cut into overlapping
pieces, each a word.  A misspelt word shares most n-grams with the word meant, so it scores alike.
Labels are known for documents only, and a few words make a document toxic: training first gives every window its document's label, then twice keeps only the windows of
toxic documents that score highest.  A document's score is its highest window's logit, calibrated
on the training documents by a logistic with the class shares of all labels.

The classifier is fitted on at most SAMPLE labelled ids of each class by hash order, and where ids
repeat on at most 2 * SAMPLE rows, by hash order too; none is over FIT_CHARS characters.  Whole texts
of all documents are scored.  Only the text enters a score.
Null, empty and wordless texts score 0.  Repeated rows score alike.  Without labels of both
classes every score is 0.  Rows whose crc32(doc_id) mod 3 is 1 are never trained on.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table, text_batches

#: Documents of each class that the classifier is fitted on, at most, and their greatest length.
SAMPLE = 700
FIT_CHARS = 40_000
#: Words of a window; one starts at every word.
WINDOW = 8
#: Characters of a word; longer ones, as in text without white space, are scored in pieces.
LONGEST = 64
BUCKET_BITS, WIDTH = 18, 8
BUCKETS = 1 << BUCKET_BITS
EPOCHS = (40, 40, 40)
#: Training documents that must share an n-gram; others embed to zero, so what one document has alone is not learnt by heart.
LEAST_DOCS = 4
#: Adam's epsilon: steps of n-grams with gradients below it, the rare ones, stay short.
EPSILON = 1e-6
#: Weight decay per step.
DECAY = 0.01
THRESHOLD = 0.7
#: Raw tokens that a worker remembers.
MEMO_WORDS = 300_000
_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def words(text: str) -> list[str]:
    """Lower-cased words without ASCII punctuation around them, long ones in pieces; a run of one word counts once."""
    found = [w.strip(_EDGE) for w in text.lower().split()]
    if max(map(len, found), default=0) > LONGEST:
        found = [p for w in found for p in pieces(w)]
    return [w for w, _ in groupby(found) if w]


def pieces(word: str) -> list[str]:
    """The word, or pieces of LONGEST characters that overlap by half."""
    return [word[a:a + LONGEST] for a in range(0, max(1, len(word) - LONGEST // 2), LONGEST // 2)]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each word itself and of its character 3- to 5-grams with both ends marked."""
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    owner = np.repeat(np.arange(len(marked)), sizes)
    room = np.cumsum(sizes)[owner] - np.arange(len(code))
    own = [np.arange(len(marked))]
    buckets = [np.array([zlib.crc32(m.encode()) % BUCKETS for m in marked], dtype=np.int64)]
    rolled = code.copy()
    for n in range(2, 6):
        rolled = rolled[:-1] * _BASE + code[n - 1:]
        if n > 2:
            at = np.flatnonzero(room[:len(rolled)] >= n)
            own.append(owner[at])
            buckets.append(((rolled[at] * _SPREAD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(own), np.concatenate(buckets)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """``value[bucket]``: the embedding's product with the softmax's difference of classes."""

    value: np.ndarray
    bias: float
    slope: float
    shift: float

    def logit(self, values: np.ndarray) -> float:
        """The highest window's logit."""
        n = len(values)
        if n <= WINDOW:
            return float(values.sum() / WINDOW + self.bias)
        total = np.concatenate([[0.0], np.cumsum(values)])
        return float((total[WINDOW:] - total[:-WINDOW]).max() / WINDOW + self.bias)

    def score(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30))))

    def word_values(self, words: list[str]) -> np.ndarray:
        """Of each word the mean over its n-grams."""
        own, buckets = grams(words)
        return np.bincount(own, weights=self.value[buckets], minlength=len(words)) / np.bincount(own, minlength=len(words))


def fit(texts: list[str], labels: list[int], share: float, seed: int = 7) -> Model | None:
    """Of the texts and their labels; ``share`` of all labels are toxic.  None without both classes."""
    index: dict[str, int] = {}
    parts, sizes_of, y_of = [], [], []  # word numbers of each document; -1 is no word
    for text, y in zip(texts, labels):
        if bag := words(text):
            ids = [index.setdefault(w, len(index)) for w in bag]
            parts.append(np.array(ids + [-1] * (WINDOW - len(ids)), dtype=np.int32))
            sizes_of.append(len(ids))
            y_of.append(y)
    if len(set(y_of)) < 2:
        return None
    tokens, count = np.concatenate(parts), np.array([len(p) - WINDOW + 1 for p in parts])
    first = np.cumsum(count) - count  # each document's first window
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), count)
    starts = np.arange(len(owner)) + owner * (WINDOW - 1)
    y_doc = np.array(y_of)
    word_of, bucket_of = grams(list(index))
    order = np.argsort(word_of, kind="stable")
    word_of, bucket_of = word_of[order].astype(np.int32), bucket_of[order].astype(np.int32)
    stops = np.cumsum(np.bincount(word_of, minlength=len(index)))
    sizes = np.diff(stops, prepend=0).astype(np.float32)
    held = np.zeros(BUCKETS, dtype=np.int32)  # documents that hold each n-gram
    for p, n in zip(parts, sizes_of):
        held[np.unique(np.concatenate([bucket_of[stops[k] - int(sizes[k]):stops[k]] for k in np.unique(p[:n]).tolist()]))] += 1
    used = np.flatnonzero(held >= LEAST_DOCS)
    del index, held, order
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    kept = place[bucket_of] >= 0
    word_of, gram_of = word_of[kept], place[bucket_of[kept]]
    rnd = np.random.default_rng(seed)
    E = rnd.normal(0, 0.1, (len(used), WIDTH)).astype(np.float32)
    W = rnd.normal(0, 0.5, WIDTH).astype(np.float32)
    bias = 0.0

    def per_word(of_gram: np.ndarray) -> np.ndarray:
        """The mean over each word's n-grams; a last 0 is for no word."""
        return np.append(np.bincount(word_of, weights=of_gram[gram_of], minlength=len(sizes)) / sizes, 0.0).astype(np.float32)

    def logits() -> np.ndarray:
        """Of all windows."""
        total = np.concatenate([[0.0], np.cumsum(per_word(E @ W)[tokens], dtype=np.float64)])
        return (total[starts + WINDOW] - total[starts]) / WINDOW + bias

    def train(some: np.ndarray, y: np.ndarray, epochs: int) -> None:
        """Full-batch Adam with weight decay; both classes weigh alike."""
        nonlocal E, W, bias
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
        state = [np.zeros_like(E), np.zeros_like(E), np.zeros_like(W), np.zeros_like(W)]
        flat = np.where(tokens < 0, len(sizes), tokens)
        for t in range(1, epochs + 1):
            g = (1 / (1 + np.exp(-logits()[some])) - y) * weight
            edge = np.zeros(len(tokens) + 1)
            edge[starts[some]] += g / WINDOW
            edge[starts[some] + WINDOW] -= g / WINDOW
            of_word = np.bincount(flat, weights=np.cumsum(edge)[:-1], minlength=len(sizes) + 1)[:-1] / sizes
            of_gram = np.bincount(gram_of, weights=of_word[word_of], minlength=len(used)).astype(np.float32)
            # the softmax sees sums of embeddings, so both gradients follow from one weight per n-gram
            grads = (of_gram[:, None] * W[None, :], of_gram @ E)
            for k, (x, grad, rate) in enumerate(((E, grads[0], 0.08), (W, grads[1], 0.05))):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                x -= rate * ((m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + EPSILON) + DECAY * x)
            bias -= 0.5 * float(g.sum())

    y_win = y_doc[owner]
    every = np.arange(len(starts))
    train(every, y_win.astype(np.float32), EPOCHS[0])
    for epochs in EPOCHS[1:]:
        order = np.lexsort((-logits(), owner))
        rank = np.empty(len(order), dtype=int)
        rank[order] = np.arange(len(order)) - first[owner[order]]
        keep = (y_win == 0) | (rank < np.maximum(1, count // 20)[owner])
        train(every[keep], y_win[keep].astype(np.float32), epochs)
    model = Model(np.zeros(BUCKETS, dtype=np.float32), bias, 1.0, 0.0)
    model.value[used] = E @ W
    values = per_word(E @ W)
    x = np.array([model.logit(values[p[:n]]) for p, n in zip(parts, sizes_of)])
    weight = np.where(y_doc == 1, share / max(1, y_doc.sum()), (1 - share) / max(1, (1 - y_doc).sum()))
    scale = max(float(np.std(x)), 1e-6)
    a, b, mid = 1.0, 0.0, float(np.median(x))
    z = (x - mid) / scale
    for _ in range(60):  # Newton with a small ridge: the two classes may be separable
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = weight * (p - y_doc), weight * p * (1 - p)
        grad = np.array([(g * z).sum() + 1e-4 * a, g.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-4, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = a / scale, b - a * mid / scale
    return model


def train_on(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits the classifier on the bounded sample, in a task: the driver gets the model alone, about 1 MB."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = counts[1] / (counts[0] + counts[1])
    ids = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).union(known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    rows = docs.select("doc_id", "text").where(F.length("text") <= FIT_CHARS).join(F.broadcast(ids), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "toxic", "text").limit(2 * SAMPLE).select("doc_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        model = fit([t for *_, t in held], [y for _, y, _ in held], share) if held else None
        out = [] if model is None else [pickle.dumps((model.value.tobytes(), model.bias, model.slope, model.shift))]
        yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    if not found:
        return None
    value, *rest = pickle.loads(found[0].model)
    return Model(np.frombuffer(value, dtype=np.float32), *rest)


class _Values:
    """Of a worker: the values of texts' words, looked up by what stands between white space."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {"": 0}  # of raw tokens; 0: no word, -1: a long one, in pieces
        self.known: dict[str, int] = {"": 0}  # of words
        self.value = np.zeros(1)

    def _learn(self, tokens: set[str]) -> None:
        new = []
        for token in tokens:
            word = token.strip(_EDGE)
            if len(word) > LONGEST:
                self.number[token] = -1
            else:
                n = self.number[token] = self.known.setdefault(word, len(self.known))
                if n == len(self.value) + len(new):
                    new.append(word)
        if new:
            self.value = np.concatenate([self.value, self.model.word_values(new)])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """As ``words`` of each: stripped, long ones in pieces, a run of one word once."""
        if len(self.number) > MEMO_WORDS:
            self.clear()
        tokens = [t.lower().split() for t in texts]
        get, new = self.number.get, set()
        found = [list(map(get, own)) for own in tokens]
        for own, numbers in zip(tokens, found):
            if None in numbers:
                new.update(t for t, n in zip(own, numbers) if n is None)
        self._learn(new)
        out = []
        for text, own, numbers in zip(texts, tokens, found):
            if None in numbers:
                numbers = list(map(get, own))
            if -1 in numbers:
                out.append(self.model.word_values(words(text)))
                continue
            n = np.array(numbers, dtype=np.int64)
            keep = n > 0
            keep[1:] &= n[1:] != n[:-1]
            out.append(self.value[n[keep]])
        return out


def score(docs: DataFrame, model: Model | None, out_col: str = "toxic_score") -> DataFrame:
    """All columns of ``docs`` and the score; ``out_col`` must not be one of them."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(out_col, DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = model and _Values(model)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            bags = values([t or "" for t in texts]) if model else [()] * len(texts)
            scores = [model.score(model.logit(bag)) if len(bag) else 0.0 for bag in bags]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, type=pa.float64())], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train_on(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't call toxic, with their columns, whatever their names.

    Documents of null, empty or wordless text stay, as do all where labels lack a class; an empty table stays empty.
    """
    text_batches(spark)
    model, name = train_on(docs, table(spark, sf_dir, "labels")), fresh("toxic_score", docs)
    return score(docs, model, name).where(F.col(name) < THRESHOLD).drop(name)
