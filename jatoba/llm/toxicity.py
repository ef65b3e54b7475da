"""Toxic passages by maximum-scoring segment search.

1. Document counts of the tokens of toxic and other labelled documents (at most ``SAMPLE``) give log-odds with an informative Dirichlet
   prior (the prior is the corpus of labelled documents itself); tokens with |z| >= ``Z_LEAST`` keep
   their log-odds, all others score the same small negative drift.
2. One linear scan per document finds all maximal scoring segments.
3. A segment of score S in a text of n tokens has the expected count E = K n exp(-lambda S) of
   segments as good by chance, lambda being the positive root of sum p exp(lambda s) = 1 over the
   background.  Segments with E < ``E_MOST`` are significant; their sum statistic -ln(E) is summed.
4. A two-parameter logistic curve, fitted to the binned statistics of the same documents,
   turns the sum into a probability.

Edge cases: null and empty texts score as a text without toxic passages; very long texts are scanned
whole in linear time; rows that repeat score alike; a label that is null, or whose document is
missing, teaches nothing; unless documents of both classes are labelled every score is the share of
toxic ones among those that are (0 without any), and ``keep_clean``, which then has no evidence on any
text, keeps all rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import claim, documents, pick, slices, table, trim

PRIOR_SHARE, Z_LEAST, DRIFT, E_MOST, K = 0.3, 4.0, 0.08, 0.05, 0.05
#: The most labelled documents that are learnt from (a sample by hash of the id, small enough to broadcast); it
#: bounds the lexicon too, as a significant token is in a dozen of them or more.
SAMPLE = 30_000
CUT = 0.3
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_~`^+=/\\…«»“”‘’¿¡"


def tokens(text: str | None) -> list[str]:
    return [w.strip(_EDGES) for w in text.lower().split()] if text else []


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in one pass with a stack.

    Each candidate keeps the cumulative score left of it and up to its end; a new positive score
    joins the nearest candidate whose left sum is smaller, if it also ends lower.
    """
    stack: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, left = i, total
        total += s
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= total:
                break
            start, left = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((start, i + 1, left, total))
    return [(a, b, r - left) for a, b, left, r in stack]


@dataclass
class Model:
    """Everything a scan needs; its size is bounded by SAMPLE."""

    weights: dict[str, float]
    lam: float
    slope: float = 0.0
    offset: float = -20.0

    def segments(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """Significant segments (first token, end, score, -ln E)."""
        words = tokens(text)
        get = self.weights.get
        known = [(i, s) for i, w in enumerate(words) if (s := get(w)) is not None]
        if not known or not any(s > 0 for _, s in known):
            return []
        # runs of unlisted tokens are one element each: segments begin and end on positive scores
        scores, at, last = [], [], 0
        for i, s in known:
            if i > last:
                scores.append(-DRIFT * (i - last))
                at.append(last)
            scores.append(s)
            at.append(i)
            last = i + 1
        out = []
        for a, b, s in maximal_segments(scores):
            log_e = np.log(K * len(words)) - self.lam * s
            if log_e < np.log(E_MOST):
                out.append((at[a], at[b - 1] + 1, s, -float(log_e)))
        return out

    def statistic(self, text: str | None) -> float:
        return sum(x for *_, x in self.segments(text))

    def probability(self, t: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.log1p(t) + self.offset)))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with all their columns."""
    if not model.weights:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = np.array([model.statistic(x) for x in batch.column("text").to_pylist()], float)
            yield batch.filter(pa.array(model.probability(t) < CUT))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))


def token_counts(labelled: DataFrame) -> DataFrame:
    """token, toxic, other: counts over all labelled documents (text, toxic), combined batch by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim()
        for pdf in frames:
            for at in range(0, len(pdf), 256):  # few texts at once: their tokens are many times as large
                part = pdf.iloc[at : at + 256]
                both = (Counter(), Counter())
                for text, label in zip(part["text"], part["label"], strict=True):
                    both[int(label)].update(set(tokens(text)))
                names = list(both[0] | both[1])
                if names:
                    yield pd.DataFrame({"token": names, "n0": [both[0][w] for w in names], "n1": [both[1][w] for w in names]})
        trim()

    return labelled.select("text", "label").mapInPandas(run, "token string, n0 bigint, n1 bigint").filter("token <> ''").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def log_odds(counts: DataFrame, n0: int, n1: int) -> DataFrame:
    """token, n0, n1, delta, z."""
    n = n0 + n1
    prior = PRIOR_SHARE * (F.col("n0") + F.col("n1"))
    a0 = PRIOR_SHARE * n
    odds = lambda y, total: F.log((y + prior) / (total + a0 - y - prior))
    delta = odds(F.col("n1"), F.lit(float(n1))) - odds(F.col("n0"), F.lit(float(n0)))
    sd = F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    return counts.withColumn("delta", delta).withColumn("z", delta / sd).withColumn("p", (F.col("n0") + prior) / (n0 + a0))


def decay(scores: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(x s) + (1 - sum p) exp(-x drift) = 1."""
    rest = max(0.0, 1 - p.sum())
    f = lambda x: float((p * np.exp(x * scores)).sum() + rest * np.exp(-x * DRIFT) - 1)
    low, high = 1e-6, 50.0 / max(1.0, scores.max(initial=1.0))
    if f(low) > 0:  # the mean is positive: no root; scores are then taken in natural units
        return 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``labels`` (doc_id, label 0/1), at most SAMPLE of them, whose document is in ``docs``."""
    sample = labels.filter("label in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    known = docs.join(F.broadcast(sample), "doc_id")
    seen = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(seen) < 2:
        return Model({}, 1.0, 0.0, 40.0 if seen.get(1) else -40.0)
    counts = token_counts(known).persist()
    try:
        total = counts.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
        n0, n1 = int(total[0]), int(total[1])
        if not n0 or not n1:
            share = seen[1] / (seen[0] + seen[1])
            return Model({}, 1.0, 0.0, float(np.log(share / (1 - share))))
        strong = log_odds(counts, n0, n1).filter(F.abs("z") >= Z_LEAST)
        rows = strong.orderBy("token").collect()
    finally:
        counts.unpersist()
    weights = {r["token"]: float(r["delta"]) for r in rows}
    s, p = np.array([r["delta"] for r in rows]), np.array([r["p"] for r in rows])
    model = Model(weights, decay(s, p) if len(rows) else 1.0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            t = np.array([model.statistic(x) for x in pdf["text"]], float)
            yield pd.DataFrame({"bin": np.round(np.log1p(t) * 20).astype(int), "label": pdf["label"].astype(int), "n": 1})

    binned = known.select("text", "label").mapInPandas(run, "bin int, label int, n bigint").groupBy("bin", "label").agg(F.sum("n").alias("n")).collect()
    x = np.array([r["bin"] / 20 for r in binned])
    y, n = np.array([r["label"] for r in binned], float), np.array([r["n"] for r in binned], float)
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (n * (y - q)) - 0.5 * w
        hess = (design * (n * q * (1 - q))[:, None]).T @ design + 0.5 * np.eye(2)
        w += np.clip(np.linalg.solve(hess, grad), -4, 4)
    model.slope, model.offset = max(0.0, float(w[0])), float(w[1])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add score and segments array<struct<first, end, score, evidence>> (token numbers)."""
    names = docs.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [model.segments(t) for t in pdf["text"]]
            out = pdf[names].copy()
            out["score"] = model.probability(np.array([sum(x[3] for x in f) for f in found], float))
            out["segments"] = [[{"first": a, "end": b, "score": s, "evidence": e} for a, b, s, e in f] for f in found]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(run, f"{schema}, score double, segments array<struct<first:bigint,end:bigint,score:double,evidence:double>>")


def labelled(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """doc_id, label; a document with several labels counts once, with the larger."""
    rows = pick(table(spark, sf_dir, "labels"), doc_id="bigint", **{kind: "int"})
    return rows.filter(F.col("doc_id").isNotNull() & F.col(kind).isNotNull()).groupBy("doc_id").agg(F.max(kind).alias("label"))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    rows = labelled(spark, sf_dir, "toxic").filter(~held_out(F.col("doc_id"), 4, 2))
    return train(docs.select("doc_id", "text"), rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    scored = score(docs, fitted(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
