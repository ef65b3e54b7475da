"""Passages that repeat, by a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words.  A word goes if a window covers it whose words also start in
a document with a smaller id.

0. A text that equals the text of a smaller id loses every word that a window covers, which is all of
   them if it has a window at all; such copies take no part in what follows.
1. Of each window the least hash of its ``GRAM``-word grams is its fingerprint; windows that follow
   one another mostly share it, so a run of them is one passage with one fingerprint, and equal
   windows have equal fingerprints wherever they are.
2. Fingerprints of one text only can't matter (least and greatest hash of a text per fingerprint,
   combined before the shuffle).  What is left are candidate passages.
3. Distinct candidate passages go to the shard of their fingerprint, each with the least id it has
   there; copies of a passage are joined inside each task first, so a passage of a third of all
   documents arrives once per task.  A shard builds an FM-index over its passages (a wavelet matrix
   under a Burrows-Wheeler transform) and streams them through backward search: matching statistics
   of at least ``WINDOW`` words report the least id of every document that has that window.
4. Passages take their windows' owners back to the documents by an equi-join.

Windows that are equal in words are equal in shard, so shards never need one another, and their
number follows the number of documents.

Edge cases: a null text has no words; a text shorter than a window loses nothing; a very long text
is many passages; rows that repeat (one id, one text) are judged alike and don't remove one another,
as no id is smaller; a null id neither removes nor loses words; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import hashing
from .common import documents, slices, stash, table
from .fmindex import FMIndex

WINDOW, GRAM = 13, 4
#: The most windows of a passage; longer runs are cut.
RUN = 48
#: Documents per shard, about.
SHARD_DOCS = 1500
#: Rows with one fingerprint from which on its runs are sent window by window, and copies of one text from which on
#: they are joined apart (or a ten-thousandth of all rows, if that is more).
HOT_ROWS, HOT_COPIES = 50_000, 4096
#: Bytes of passages that a task gathers before it sends them.
PACK_BYTES = 16 << 20


def _runs(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: text number, first word (in the text), windows, fingerprint of each run."""
    w = hashing.words(batch.column("text"))
    n = len(w.hashes)
    if n < window:
        e = np.empty(0, np.int64)
        return e, e, e, e.view(np.uint64)
    gram = min(GRAM, window)
    low = hashing.grams(w.hashes, gram)
    have, span = 1, window - gram + 1  # least over ``span`` grams, by doubling
    while have * 2 <= span:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    ok = hashing.within(w.first, n, window)
    owner = hashing.owners(w.first)[: len(low)]
    at = np.arange(len(low)) - w.first[owner]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | ~ok[:-1]
    new &= ok
    # cut long runs
    number = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    if not len(begin):
        e = np.empty(0, np.int64)
        return e, e, e, e.view(np.uint64)
    since = np.arange(len(low)) - begin[np.maximum(number, 0)]
    new |= ok & (number >= 0) & (since % RUN == 0)
    begin = np.flatnonzero(new)
    sizes = np.add.reduceat(ok.astype(np.int64), begin)
    return owner[begin], at[begin], sizes, low[begin]


def _shared(keyed: DataFrame, window: int) -> DataFrame:
    """(fp, hot): fingerprints of two texts or more, and whether very many rows have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, _, _, low = _runs(batch, window)
            ids = batch.column("th").to_numpy(zero_copy_only=False)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(hashing.signed(low)), pa.array(ids)], ["fp", "t"])

    rows = keyed.filter("doc_id is not null").select("th", "text").mapInArrow(run, "fp bigint, t bigint")
    return rows.groupBy("fp").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b").select("fp", (F.col("n") > HOT_ROWS).alias("hot"))


def _copies(keyed: DataFrame) -> DataFrame:
    """Row keys of texts that a smaller id also has."""
    rows = keyed.filter("doc_id is not null and text is not null").select("doc_id", "rid", "th", F.xxhash64(F.lit(7), "text").alias("th2"))
    least = stash(rows.groupBy("th", "th2").agg(F.min("doc_id").alias("d"), F.count(F.lit(1)).alias("c")).filter("c > 1"))
    # texts of very many rows (few, whatever the table's size) are joined apart, so no task gets all their rows
    most = max(HOT_COPIES, keyed.count() // 10_000)
    hot = F.broadcast(least.filter(F.col("c") > most))
    rest = rows.join(hot.select("th", "th2"), ["th", "th2"], "left_anti").join(least.filter(F.col("c") <= most), ["th", "th2"])
    return rest.unionByName(rows.join(hot, ["th", "th2"])).filter("doc_id > d").select("rid").distinct()


def _candidates(keyed: DataFrame, copies: DataFrame, window: int) -> DataFrame:
    """Per row key the first words of runs that other texts may share; those of hot fingerprints below zero (-1 - first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, at, _, low = _runs(batch, window)
            ids = batch.column("rid").to_numpy(zero_copy_only=False)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(hashing.signed(low)), pa.array(ids), pa.array(at.astype(np.int32))], ["fp", "rid", "first"])

    rows = keyed.filter("doc_id is not null").select("rid", "text").mapInArrow(run, "fp bigint, rid bigint, first int")
    kept = rows.join(_shared(keyed, window), "fp").withColumn("first", F.when(F.col("hot"), -1 - F.col("first")).otherwise(F.col("first")))
    return kept.groupBy("rid").agg(F.collect_list("first").alias("runs")).join(copies, "rid", "left_anti")


def _marked(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Of a slice with ``runs``: text number, first word, fingerprint and words of the runs that are asked for.  A run of a
    hot fingerprint comes window by window, each with a fingerprint of its own: equal windows still meet in one shard,
    but the surroundings of one frequent phrase are dealt to all."""
    if batch.column("runs").null_count == len(batch):
        return
    owner, at, size, low = _runs(batch, window)
    asked = [set(r) if r is not None else () for r in batch.column("runs").to_pylist()]
    texts = batch.column("text").cast(pa.binary())
    last, words = -1, []
    for o, a, n, fp in zip(owner.tolist(), at.tolist(), size.tolist(), hashing.signed(low).tolist(), strict=True):
        hot = -1 - a in asked[o]
        if hot or a in asked[o]:
            if o != last:
                last, words = o, _words(texts[o].as_py())
            if not hot:
                yield o, a, fp, b" ".join(words[a : a + n + window - 1])
                continue
            for k in range(a, a + n):
                raw = b" ".join(words[k : k + window])
                yield o, k, xxhash.xxh3_64_intdigest(raw, 1), raw


def _words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def _passages(joined: DataFrame, shards: int, window: int) -> DataFrame:
    """Distinct candidate passages of each task, many to a row: (shard, ph, d, words, size), the hashes and
    ids as 64-bit numbers, the passages compressed.  A passage that comes again with a smaller id is
    sent again without its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        held: dict[int, list[tuple[int, int, bytes]]] = {}
        total = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for shard, found in held.items():
                words = b"\n".join(x[2] for x in found)
                rows.append((shard, np.array([x[0] for x in found], np.int64).tobytes(), np.array([x[1] for x in found], np.int64).tobytes(), pa.compress(words, "zstd", asbytes=True), len(words)))
            held.clear()
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["shard", "ph", "d", "words", "size"])

        for batch in slices(batches):
            docs = batch.column("doc_id").to_pylist()
            for o, _, fp, raw in _marked(batch, window):
                ph, doc = xxhash.xxh3_64_intdigest(raw) - (1 << 63), docs[o]
                had = least.get(ph)
                if had is None or doc < had:
                    least[ph] = doc
                    held.setdefault(fp % shards, []).append((ph, doc, raw if had is None else b""))
                    total += len(raw)
            if total > PACK_BYTES:
                yield flush()
                total = 0
        if held:
            yield flush()

    return joined.mapInArrow(run, "shard int, ph binary, d binary, words binary, size bigint")


def _occurrences(joined: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            docs, rids = batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist()
            out = [(xxhash.xxh3_64_intdigest(raw) - (1 << 63), rids[o], docs[o], first) for o, first, _, raw in _marked(batch, window)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["ph", "rid", "d", "first"])

    return joined.mapInArrow(run, "ph bigint, rid bigint, d bigint, first int")


def shard_owners(packed: pd.DataFrame, window: int) -> pd.DataFrame:
    """One shard: (ph, owners), the least id of every document that has each window of the passage."""
    pdf = pd.DataFrame({
        "ph": np.concatenate([np.frombuffer(x, np.int64) for x in packed["ph"]]),
        "d": np.concatenate([np.frombuffer(x, np.int64) for x in packed["d"]]),
        "passage": [p for w, n in zip(packed["words"], packed["size"], strict=True) for p in pa.decompress(w, int(n), "zstd", asbytes=True).split(b"\n")],
    })
    least = pdf.groupby("ph")["d"].min()
    words = pdf[pdf["passage"] != b""].drop_duplicates("ph")
    codes: dict[bytes, int] = {}
    docs = [np.array([codes.setdefault(w, len(codes) + 1) for w in p.split(b" ")], np.int64) for p in words["passage"]]
    index = FMIndex(docs, least[words["ph"]].to_numpy(np.int64), window)
    _, owners = index.statistics(docs)
    return pd.DataFrame({"ph": words["ph"].to_numpy(), "owners": [o[: len(o) - window + 1] for o in owners]})


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, starts, copy): the first words of windows that a smaller id also has; of a copy, all."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"), F.xxhash64("text").alias("th"))
    shards = docs.count() // SHARD_DOCS + 32
    copies = stash(_copies(keyed))
    by_row = keyed.select("rid", "doc_id", "text")
    joined = by_row.join(_candidates(keyed, copies, window), "rid", "left").select("rid", "doc_id", "text", "runs")
    owners = _passages(joined, shards, window).groupBy("shard").applyInPandas(lambda pdf: shard_owners(pdf, window), "ph bigint, owners array<bigint>")
    hit = _occurrences(joined, window).join(owners, "ph")
    lost = F.filter(F.transform("owners", lambda o, i: F.when(o < F.col("d"), F.col("first") + i)), lambda x: x.isNotNull())
    starts = hit.select("rid", lost.alias("s")).filter(F.size("s") > 0).groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("starts"))
    return by_row.join(starts, "rid", "left").join(copies.withColumn("copy", F.lit(True)), "rid", "left").select("doc_id", "text", "starts", "copy")


def covered(n_words: int, starts: list[int] | np.ndarray, window: int) -> np.ndarray:
    """Which words the windows cover."""
    edge = np.zeros(n_words + 1, np.int64)
    if len(starts):
        np.add.at(edge, np.asarray(starts), 1)
        np.add.at(edge, np.asarray(starts) + window, -1)
    return np.cumsum(edge)[:n_words] > 0


def _kept(words: list[bytes], starts: list[int] | None, copy: bool | None, window: int) -> list[bytes]:
    if copy and len(words) >= window:
        return []
    if not starts:
        return words
    gone = covered(len(words), starts, window)
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text (the kept words joined by a space), spans array<struct<first, end>> of removed words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, spans = [], []
            for text, s, copy in zip(pdf["text"], pdf["starts"], pdf["copy"], strict=True):
                words = _words(text.encode("utf-8", "surrogatepass") if text else b"")
                whole = copy is True and len(words) >= window
                gone = np.ones(len(words), np.int8) if whole else covered(len(words), s if s is not None else [], window).astype(np.int8)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                spans.append([{"first": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                texts.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode("utf-8", "replace"))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "spans": spans})

    return repeats(docs, window).mapInPandas(run, "doc_id bigint, text string, spans array<struct<first:int,end:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, text, s, copy in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("starts").to_pylist(), batch.column("copy").to_pylist(), strict=True):
                words = _words(text)
                kept = _kept(words, s, copy, WINDOW)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeats(docs).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
