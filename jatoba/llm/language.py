"""Language by a string kernel: blended-spectrum presence, Nyström landmarks, one-versus-rest kernel ridge regression.

1. A text is the set of its distinct runs of 1 to ``ORDER`` characters, in lower case, everything but letters being one
   space.  Runs are packed into 64-bit numbers, exactly.  The kernel of two texts is the number of runs in both, over the root
   of the product of their own numbers.
2. Landmarks are at most ``LANDMARKS`` labelled documents, as many of each language as can be, by hash of the id.  With
   K the kernel among them, a text's features are its kernel values times K to the power -1/2.
3. Ridge regression on the features of at most ``SAMPLE`` labelled documents, again spread over the languages, has one column
   a language, its targets +1 and -1.  A temperature, fitted to a part of the sample that was not learnt from, turns the columns into
   probabilities; the highest one is the score.
4. Texts are scored in batches: presence matrix times landmark matrix, normalised, times the map to languages.

Edge cases: null, empty and letterless texts are ``und`` with score 0; very long texts are read whole; rows that repeat score
alike; a null label, or that of a null, empty or letterless text, teaches nothing; without labels every text is ``und``, with
one language every text that has a letter is of it; languages beyond ``LANDMARKS`` share none: at least one landmark each is kept, so there may be
more landmarks then; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import pick, slices, table
from .toxicity import held_out

ORDER, LANDMARKS, SAMPLE = 3, 128, 6_000
RIDGE, BATCH = 1e-3, 64
UNKNOWN = "und"
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    """For each code point its lower case, or a space where it is not a letter."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def runs(text: str | None) -> np.ndarray:
    """The distinct runs of 1 to ORDER characters, sorted; none for a text without letters."""
    if not text:
        return np.empty(0, np.uint64)
    a = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    gap = a == _SPACE
    a = np.concatenate(([_SPACE], a[~gap | ~np.concatenate(([True], gap[:-1]))], [_SPACE])).astype(np.uint64)
    if (a == _SPACE).all():
        return np.empty(0, np.uint64)
    if a[-2] == _SPACE:
        a = a[:-1]
    grams, all_runs = a, [a]
    for k in range(1, ORDER):
        grams = (grams[: len(a) - k] << np.uint64(21)) | a[k:]
        all_runs.append(grams)
    found = np.sort(np.concatenate(all_runs))
    return found[np.concatenate(([True], found[1:] != found[:-1]))]


@dataclass
class Model:
    """Landmarks as rows of one presence matrix; all sizes are bounded by LANDMARKS and the alphabet."""

    names: list[str]
    known: np.ndarray  # sorted runs of the landmarks
    bits: np.ndarray  # packed presence, runs x landmarks
    sizes: np.ndarray  # runs of each landmark
    weights: np.ndarray  # landmarks x languages
    temperature: float = 1.0

    def kernel(self, texts: list[str | None]) -> np.ndarray:
        """Texts x landmarks."""
        matrix = self.matrix()
        out = np.zeros((len(texts), len(self.sizes)), np.float32)
        for at in range(0, len(texts), BATCH):
            part = [runs(t) for t in texts[at : at + BATCH]]
            there = np.zeros((len(part), len(self.known)), np.float32)
            for row, r in zip(there, part, strict=True):
                where = np.minimum(np.searchsorted(self.known, r), len(self.known) - 1)
                row[where[self.known[where] == r]] = 1
            norm = np.sqrt(np.maximum(1, [len(r) for r in part]))[:, None] * np.sqrt(self.sizes)[None, :]
            out[at : at + BATCH] = there @ matrix / norm
        return out

    def matrix(self) -> np.ndarray:
        if getattr(self, "_matrix", None) is None:
            self._matrix = np.unpackbits(self.bits, axis=1, count=len(self.sizes)).astype(np.float32)
        return self._matrix

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_matrix"}

    def probabilities(self, kernel: np.ndarray) -> np.ndarray:
        z = kernel @ self.weights / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _chosen(labelled: DataFrame, most: int, counts: dict[str, int], seed: int) -> DataFrame:
    """About ``most`` rows, equal numbers of each language as far as there are any, by a threshold on a hash of the id."""
    share = {}
    left, todo = most, sorted(counts, key=lambda c: (counts[c], c))
    for i, name in enumerate(todo):
        n = min(counts[name], max(1, left // (len(todo) - i)))
        share[name] = n / counts[name]
        left -= n
    limit = F.create_map(*[F.lit(x) for name, s in share.items() for x in (name, float(s))])
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    return labelled.filter(u < limit[F.col("lang")]).dropDuplicates(["doc_id", "lang", "text"])  # rows that repeat share a hash


def _landmarks(labelled: DataFrame, counts: dict[str, int], most: int) -> list[tuple[str, np.ndarray]]:
    """(language, runs) of the landmarks; at least one of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            packed = [runs(t).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(packed, pa.binary())], names=["doc_id", "lang", "runs"])

    def collected(some: DataFrame) -> list:
        return some.mapInArrow(run, "doc_id bigint, lang string, runs binary").orderBy("doc_id", "runs").collect()

    rows = collected(_chosen(labelled, most, counts, 1))
    missing = sorted(set(counts) - {r["lang"] for r in rows})
    if missing:  # small languages that the hash passed over: their least ids
        least = labelled.filter(F.col("lang").isin(missing)).groupBy("lang").agg(F.min(F.struct("doc_id", "text")).alias("d"))
        rows += collected(least.select("d.doc_id", "d.text", "lang"))
    return [(r["lang"], np.frombuffer(r["runs"], np.uint64)) for r in rows]


def train(docs: DataFrame, landmarks: int = LANDMARKS, sample: int = SAMPLE) -> Model | None:
    """Learn from docs (doc_id, text, lang); rows without a language or a letter are passed over.  None without any."""
    labelled = docs.filter(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    names = sorted(counts)
    marks = _landmarks(labelled, counts, landmarks)
    known = np.unique(np.concatenate([r for _, r in marks]))
    there = np.zeros((len(known), len(marks)), bool)
    for j, (_, r) in enumerate(marks):
        there[np.searchsorted(known, r), j] = True
    sizes = np.array([len(r) for _, r in marks], float)
    model = Model(names, known, np.packbits(there, axis=1), sizes, np.zeros((len(marks), len(names)), np.float32))
    if len(names) == 1:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values = model.kernel(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(values), pa.list_(pa.float32()))], names=["doc_id", "lang", "k"])

    rows = _chosen(labelled, sample, counts, 2).mapInArrow(run, "doc_id bigint, lang string, k array<float>").orderBy("doc_id", "lang", "k").collect()
    rows += [r for r in _marks_as_rows(model, marks) if r["lang"] not in {x["lang"] for x in rows}]
    x = np.array([r["k"] for r in rows], float)
    y = np.array([names.index(r["lang"]) for r in rows])
    m = model.matrix().T @ model.matrix() / np.sqrt(np.outer(sizes, sizes))
    value, vector = np.linalg.eigh(m.astype(float))
    on = value > 1e-6 * value.max()
    half = vector[:, on] / np.sqrt(value[on])  # kernel values to features
    order = np.random.default_rng(5).permutation(len(y))
    aside, learn = order[: len(y) // 5], order[len(y) // 5 :] if len(y) >= 20 else order

    def ridge(at: np.ndarray) -> np.ndarray:
        f, t = x[at] @ half, np.where(y[at][:, None] == np.arange(len(names)), 1.0, -1.0)
        weight = 1 / np.bincount(y[at], minlength=len(names)).clip(1)[y[at]]  # languages count alike
        f_w = f * (weight / weight.mean())[:, None]
        return half @ np.linalg.solve(f_w.T @ f + RIDGE * len(at) * np.eye(f.shape[1]), f_w.T @ t)

    if len(y) >= 20:
        z = x[aside] @ ridge(learn)
        loss = lambda t: float(np.mean(np.log(np.exp((z - z.max(1, keepdims=True)) / t).sum(1)) - (z[np.arange(len(aside)), y[aside]] - z.max(1)) / t))
        model.temperature = float(min(np.geomspace(0.05, 4, 45), key=loss))
    model.weights = ridge(np.arange(len(y))).astype(np.float32)
    return model


def _marks_as_rows(model: Model, marks: list[tuple[str, np.ndarray]]) -> list[dict]:
    shared = model.matrix().T @ model.matrix() / np.sqrt(np.outer(model.sizes, model.sizes))
    return [{"lang": lang, "k": shared[j]} for j, (lang, _) in enumerate(marks)]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.names, object)
        for part in slices(batches):
            p = model.probabilities(model.kernel(part.column(1).to_pylist()))
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names[best], pa.string()), pa.array(p[np.arange(len(best)), best].astype(float))], names=["doc_id", "letter", "lang", "p"])

    found = docs.select("doc_id", "text", has_letter(F.col("text")).alias("letter")).mapInArrow(run, "doc_id bigint, letter boolean, lang string, p double")
    return found.select("doc_id", F.when(F.col("letter"), F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("letter"), F.col("p")).otherwise(0.0).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="bigint", text="string", lang="string")
    aside = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.filter(~aside))
    return predict(docs, model).select("doc_id", aside.alias("held_out"), "lang_pred", "score")
