"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

Words and their shapes (case, digits, marks) fall into ``BUCKETS`` hashed types.  Each type has a sparse
random index vector; a type's word vector is the sum of the index vectors of its neighbours over the
whole corpus, damped and normalised.  A document is the mean and the spread of its word vectors, with
its length and its share of distinct words.  A two-layer network in numpy learns from at most
``SAMPLE`` labelled documents; its probabilities are calibrated by a temperature on a part of them
that it did not learn from.

Edge cases: null and empty texts are pooled to zero vectors and scored; very long texts are pooled
whole; rows that repeat score alike; a null label teaches nothing; with labels of one class or none
every score is that share (0.5 without labels); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cache, claim, documents, table
from .scan import folded
from .toxicity import held_out, labelled

BUCKETS, WIDTH, NONZERO = 4096, 32, 4
#: The most labelled documents that the network learns from (a sample by hash of the id).
SAMPLE = 12_000
HIDDEN, EPOCHS, BATCH = 24, 60, 256
_REMEMBERED = 400_000
_SHAPE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_seen: dict[str, tuple[int, int]] = cache("quality")


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(11)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for row in out:
        row[rng.choice(WIDTH, NONZERO, replace=False)] = rng.choice((-1.0, 1.0), NONZERO)
    return out


def _types(word: str) -> tuple[int, int]:
    """Buckets of the word in lower case and of its shape."""
    shape = []
    for m in _SHAPE.finditer(word):
        p = m.group()
        s = "9" if p.isdigit() else "X" if p.isupper() and len(p) > 1 else "Xx" if p[:1].isupper() else "x" if p.isalpha() else p
        if not shape or shape[-1] != s:
            shape.append(s)
    return zlib.crc32(word.lower().encode("utf-8", "replace")) % BUCKETS, zlib.crc32(("\0" + "".join(shape)).encode("utf-8", "replace")) % BUCKETS


def type_ids(text: str | None) -> np.ndarray:
    """Buckets of word, shape, word, shape, ..."""
    if not text:
        return np.empty(0, np.int64)
    words = text.split()
    try:
        pairs = [_seen[w] for w in words]
    except KeyError:
        if len(_seen) > _REMEMBERED:
            _seen.clear()
        for w in set(words):
            if w not in _seen:
                _seen[w] = _types(w)
        pairs = [_seen[w] for w in words]
    return np.array(pairs, np.int64).ravel()


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x WIDTH, from neighbours (two to each side) in all texts.  Each task sends one table of
    this fixed size, in 64 rows, and sums of them are all that the driver sees."""
    index = index_vectors()
    chunk = BUCKETS // 64

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("quality")
        total = np.zeros((BUCKETS, WIDTH), np.float64)
        positions = np.stack([np.flatnonzero(r) for r in index])
        signs = np.stack([r[np.flatnonzero(r)] for r in index])
        for pdf in frames:
            for at in range(0, len(pdf), 256):
                parts = []
                for t in pdf["text"].iloc[at : at + 256]:
                    parts += [type_ids(t), np.full(4, -1)]
                ids = np.concatenate(parts)
                for gap in (1, 2, 4):
                    a, b = ids[:-gap], ids[gap:]
                    ok = (a >= 0) & (b >= 0)
                    a, b = a[ok], b[ok]
                    for x, y in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            total += np.bincount(x * WIDTH + positions[y, k], signs[y, k], BUCKETS * WIDTH).reshape(BUCKETS, WIDTH)
        yield pd.DataFrame({"part": range(64), "v": [total[i * chunk : (i + 1) * chunk].tobytes() for i in range(64)]})

    out = np.zeros((BUCKETS, WIDTH))
    for r in folded(docs.select("text").mapInPandas(run, "part int, v binary"), np.add, "f8").collect():
        out[r["part"] * chunk : (r["part"] + 1) * chunk] = np.frombuffer(r["v"]).reshape(chunk, WIDTH)
    out = np.sign(out) * np.log1p(np.abs(out))  # frequent neighbours count less than in proportion
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).astype(np.float32)


def pooled(texts: pd.Series, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), 2 * WIDTH + 3), np.float32)
    for i, t in enumerate(texts):
        ids = type_ids(t)
        if not len(ids):
            continue
        count = np.bincount(ids, minlength=BUCKETS)
        on = np.flatnonzero(count)
        share, v = (count[on] / len(ids)).astype(np.float32), vectors[on]
        mean = share @ v
        out[i, :WIDTH] = mean
        out[i, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
        out[i, -3:] = np.log1p(len(ids)) / 10, len(on) / len(ids), share.max()
    return out


@dataclass
class Network:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, texts: pd.Series) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled(texts, self.vectors)) / self.temperature, -40, 40))).astype(float)


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 5) -> Network:
    d = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        z = np.zeros(d, np.float32)
        return Network(vectors, z, z + 1, np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside = order[: max(1, len(y) // 5)]
    learn = order[max(1, len(y) // 5) :] if len(y) > 4 else order
    mean, scale = x[learn].mean(0), x[learn].std(0) + 1e-3
    p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    xs = ((x - mean) / scale).astype(float)
    epochs = max(EPOCHS, min(400, 60_000 // max(1, len(learn))))
    for epoch in range(epochs):
        rng.shuffle(learn)
        for at in range(0, len(learn), BATCH):
            b = learn[at : at + BATCH]
            h = np.tanh(xs[b] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[b]) / len(b)
            gh = np.outer(g, p[2]) * (1 - h * h)
            grads = [xs[b].T @ gh + 1e-3 * p[0], gh.sum(0), h.T @ g + 1e-3 * p[2], np.array([g.sum()])]
            step += 1
            for k, gr in enumerate(grads):
                m[k] += 0.1 * (gr - m[k])
                v[k] += 0.001 * (gr * gr - v[k])
                p[k] -= 0.005 * (1 - 0.9 * epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]))
    z, ya = net.logits(x[aside]), y[aside]
    loss = lambda t: float(np.mean(np.logaddexp(0, z / t) - ya * z / t))
    net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def train(docs: DataFrame, labels: DataFrame) -> Network:
    vectors = word_vectors(docs)
    known = labels.filter("label in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most SAMPLE small rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": list(pooled(pdf["text"], vectors))})

    rows = sample.mapInPandas(run, "doc_id bigint, label int, x array<float>").orderBy("doc_id", "label").collect()
    x = np.array([r["x"] for r in rows], np.float32).reshape(len(rows), 2 * WIDTH + 3)
    return fit(x, np.array([r["label"] for r in rows], float), vectors)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Add score."""
    names = docs.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pdf[names].copy()
            out["score"] = net.probability(pdf["text"])
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(run, f"{schema}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    rows = labelled(spark, sf_dir, "quality").filter(~held_out(F.col("doc_id"), 3, 1))
    scored = score(docs, train(docs, rows))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
