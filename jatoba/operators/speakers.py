"""Voices: cepstral features, signatures, clustering, assignment.  A recording is one Arrow group; its size is
bounded by the anchors' limit in the quadratic part."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .sequence import in_order, speaker_rank

RATE, FRAME_MS, HOP_MS, N_FFT, N_MELS, N_COEF, LOW_HZ, HIGH_HZ, FLOOR, EMPHASIS = 16_000, 25, 20, 512, 32, 20, 60.0, 7600.0, 1e-10, 0.97
LEAST_RECORDING, LEAST_FRAMES, MIN_ANCHOR_MS, MAX_ANCHORS, THRESHOLD, MAX_SPEAKERS = 50, 8, 1200, 1200, 0.62, 8


def _filters() -> np.ndarray:
    """Triangles equally spaced on the mel scale, each divided by its width."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(mel(LOW_HZ), mel(HIGH_HZ), N_MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(N_FFT, 1 / RATE)
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    bank = np.maximum(0, np.minimum(up, down))
    total = bank.sum(1, keepdims=True)
    return bank / np.where(total == 0, 1, total)  # else wide filters, the high ones, would hold most energy


class Cepstrum:
    """MFCC of a recording that comes in blocks: what is left of a block, less than a frame, waits for the next, so
    only features grow with the recording (frames x N_COEF)."""

    def __init__(self):
        self.size, self.hop = RATE * FRAME_MS // 1000, RATE * HOP_MS // 1000
        k = np.arange(N_MELS)
        self.dct = np.sqrt(2 / N_MELS) * np.cos(np.pi * np.arange(N_COEF)[:, None] * (2 * k + 1) / (2 * N_MELS))
        self.dct[0] /= np.sqrt(2)
        self.bank = _filters()
        self.window = np.hamming(self.size)
        self.rest = np.empty(0)
        self.before: float | None = None

    def push(self, samples: np.ndarray) -> np.ndarray:
        """(frames, N_COEF) that are complete now, of mono samples in [-1, 1]."""
        x = np.asarray(samples, np.float32)
        if not len(x):
            return np.empty((0, N_COEF))
        past = np.concatenate([[0.0 if self.before is None else float(self.before)], x[:-1]])
        self.before, first = x[-1], self.before is None
        y = x - EMPHASIS * past
        if first:
            y[0] = x[0]
        y = np.concatenate([self.rest, y])
        if len(y) < self.size:
            self.rest = y
            return np.empty((0, N_COEF))
        frames = np.lib.stride_tricks.sliding_window_view(y, self.size)[:: self.hop]
        self.rest = y[len(frames) * self.hop :]
        out = []
        for at in range(0, len(frames), 4096):
            power = np.abs(np.fft.rfft(frames[at : at + 4096] * self.window, N_FFT)) ** 2 / N_FFT
            out.append(np.log(np.maximum(power @ self.bank.T, FLOOR)) @ self.dct.T)
        return np.concatenate(out)


def mfcc(samples: np.ndarray) -> np.ndarray:
    """(frames, N_COEF) of a whole recording."""
    return Cepstrum().push(samples)


def signatures(features: np.ndarray, spans: list[tuple[int, int]]) -> list[np.ndarray | None]:
    """Mean and spread over each span's frames of normalised coefficients, the first left out."""
    z = (features - features.mean(0)) / (features.std(0) + 1e-6)
    out: list[np.ndarray | None] = []
    for a, b in spans:
        part = z[a // HOP_MS : -(-b // HOP_MS), 1:]
        v = np.concatenate([part.mean(0), part.std(0)]) if len(part) >= LEAST_FRAMES else np.zeros(1)
        n = np.linalg.norm(v)
        out.append(v / n if n > 0 and len(part) >= LEAST_FRAMES else None)
    return out


def agglomerate(vectors: np.ndarray, threshold: float = THRESHOLD, most: int = MAX_SPEAKERS) -> list[int]:
    """Average linkage by cosine distance: the nearest two join while they are near, or clusters too many.

    Mean distances between clusters are sums of distances between members over products of sizes, so a join adds
    two rows of sums.  Every cluster remembers its nearest one; only those that pointed to a joined one look again."""
    n = len(vectors)
    if not n:
        return []
    total = np.clip(1 - vectors @ vectors.T, 0, 2)
    size, live, label = np.ones(n), np.ones(n, bool), np.arange(n)

    def look(rows: np.ndarray) -> None:
        mean = np.where(live, total[rows] / (size[rows, None] * size), np.inf)
        mean[np.arange(len(rows)), rows] = np.inf
        nearest[rows], gap[rows] = mean.argmin(1), mean.min(1)

    nearest, gap = np.zeros(n, int), np.full(n, np.inf)
    look(np.arange(n))
    for left in range(n, 1, -1):
        a = int(np.where(live, gap, np.inf).argmin())
        b = int(nearest[a])
        if not np.isfinite(gap[a]) or (gap[a] > threshold and left <= most):
            break
        a, b = min(a, b), max(a, b)
        total[a] += total[b]
        total[:, a] = total[a]
        size[a] += size[b]
        live[b] = False
        label[label == b] = a
        stale = live & ((nearest == a) | (nearest == b))
        stale[a] = True
        look(np.flatnonzero(stale))
        # to the others the joined cluster may have come nearer than their nearest
        mean = total[a] / (size[a] * size)
        closer = live & (mean < gap)
        closer[a] = False
        nearest[closer], gap[closer] = a, mean[closer]
    _, first, code = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[code].tolist()


def cluster(vectors: DataFrame) -> DataFrame:
    """(rec_id, seg_id, v, span_ms) to (rec_id, seg_id, cluster): anchors are long enough and at most
    MAX_ANCHORS, evenly strided; each vector goes to the nearest centroid, a null one stays null."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_id")
        has = [v is not None and len(v) > 0 for v in pdf["v"]]
        anchors = np.flatnonzero(np.array(has) & (pdf["span_ms"].to_numpy() >= MIN_ANCHOR_MS))
        if len(anchors) > MAX_ANCHORS:
            anchors = anchors[(np.arange(MAX_ANCHORS) * (len(anchors) / MAX_ANCHORS)).astype(int)]
        if len(anchors) < 3:
            return pd.DataFrame({"rec_id": [], "seg_id": [], "cluster": []})
        x = np.stack([np.asarray(pdf["v"].iloc[k], float) for k in anchors])
        label = np.array(agglomerate(x))
        c = np.stack([x[label == k].sum(0) for k in range(label.max() + 1)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = [int((c @ np.asarray(v, float)).argmax()) if ok else None for v, ok in zip(pdf["v"], has, strict=True)]
        return pd.DataFrame({"rec_id": pdf["rec_id"], "seg_id": pdf["seg_id"], "cluster": pd.array(near, "Int64")})

    return vectors.groupBy("rec_id").applyInPandas(run, "rec_id bigint, seg_id bigint, cluster int")


def assign(segs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Segments with ``speaker`` ("Falante n" by talking time) and ``speaker_id``; without enough anchors they
    are as before.  A segment without a signature has its predecessor's voice."""
    spans = segs.select("rec_id", "seg_id", (F.col("end_ms") - F.col("start_ms")).alias("span_ms"))
    labels = cluster(vectors.join(spans, ["rec_id", "seg_id"]))
    found = labels.select("rec_id").distinct().withColumn("__on", F.lit(True))
    whole = segs.join(labels, ["rec_id", "seg_id"], "left").join(found, "rec_id", "left")
    voiced = whole.withColumn("cluster", F.when(F.col("__on"), F.coalesce(F.last("cluster", ignorenulls=True).over(in_order().rowsBetween(W.unboundedPreceding, 0)), F.lit(0))))
    rank = speaker_rank(voiced, "cluster").select("rec_id", "cluster", "name", "rank")
    named = voiced.join(rank, ["rec_id", "cluster"], "left")
    return named.withColumn("speaker", F.coalesce("name", "speaker")).withColumn("speaker_id", F.col("rank") - 1).drop("cluster", "__on", "name", "rank")


def voices(audio: DataFrame, segs: DataFrame) -> DataFrame:
    """(rec_id, samples) and segments to (rec_id, seg_id, v): signatures of all segments, null where there is too little sound."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("seg_id")
        heard = Cepstrum()
        f = np.concatenate([np.empty((0, N_COEF)), *(heard.push(x) for x in left.sort_values("block")["samples"])])
        if len(f) < LEAST_RECORDING or not len(right):
            return pd.DataFrame({"rec_id": [], "seg_id": [], "v": []})
        return pd.DataFrame({"rec_id": right["rec_id"], "seg_id": right["seg_id"], "v": signatures(f, list(zip(right["start_ms"], right["end_ms"], strict=True)))})

    return audio.groupBy("rec_id").cogroup(segs.select("rec_id", "seg_id", "start_ms", "end_ms").groupBy("rec_id")).applyInPandas(run, "rec_id bigint, seg_id bigint, v array<double>")


# ---- relational forms, for vectors as arrays ---------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def centroids(vectors: DataFrame, label: str = "label", v: str = "v") -> DataFrame:
    """(label, c): sums of the members, of unit length."""
    sums = vectors.select(label, F.posexplode(v).alias("i", "x")).groupBy(label, "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(W.partitionBy(label)))
    unit = sums.withColumn("s", F.col("s") / F.when(norm == 0, 1.0).otherwise(norm))
    return unit.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("c")).select(label, F.col("c.s").alias("c"))


def nearest_centroid(vectors: DataFrame, cents: DataFrame, key: str, v: str = "v", label: str = "label", most: int = 10_000) -> DataFrame:
    """(key, label, similarity): centroids are few, one per voice; that is checked before they are sent."""
    if cents.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} centroids")
    packed = F.broadcast(cents.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("l"), F.col("c").alias("c")))).alias("__cs")))
    scored = F.transform("__cs", lambda x: F.struct(F.round(dot(F.col(v), x["c"]), 9).alias("s"), (-x["l"]).alias("n")))
    return vectors.crossJoin(packed).select(key, F.array_max(scored).alias("b")).select(key, (-F.col("b.n")).alias("nearest"), F.col("b.s").alias("similarity"))


def waveform(samples: DataFrame, points: int = 900, key: str = "rec_id", at: str = "i", x: str = "x") -> DataFrame:
    """(key, point, peak): greatest amplitude per bucket over the 99th percentile of peaks, at most 1."""
    points = max(50, min(4000, points))
    n = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.lit(1), F.floor(F.col("n") / points))
    peaks = samples.join(n, key).groupBy(key, F.floor(F.col(at) / size).cast("bigint").alias("point")).agg(F.max(F.abs(x)).alias("p"))
    top = peaks.groupBy(key).agg(F.expr("percentile(p, 0.99)").alias("q"))
    scaled = F.round(F.least(F.lit(1.0), F.col("p") / F.when(F.col("q") == 0, 1.0).otherwise(F.col("q"))), 3)
    return peaks.join(top, key).filter(F.col("point") < points).select(key, "point", scaled.alias("peak"))
