"""Pattern packing by non-negative least squares.

Documents become token ids, a separator each, and pieces of at most ``capacity`` tokens.  Only the
histogram of piece lengths (``capacity`` counts, whatever the corpus) reaches the driver:

1. lengths fall into bins; patterns are the multisets of a few bins that fit the capacity tightly;
2. non-negative least squares fits how often each pattern repeats to the binned histogram;
3. repeats are rounded down and filled with exact lengths, the longest that is left in a bin first;
4. the residual is packed best fit, longest first, into the gaps and into new sequences.

The plan says for the k-th piece of each length which sequence and offset it has, as ranges of k.
Pieces are numbered within their length by a two-level count, so neither a frequent length nor the
plan's join gathers rows in one task.

Edge cases: a null or empty text is its separator alone (length 1); rows that repeat are packed
each; a very long text is cut into many pieces; an empty table has an empty plan and no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import cache, documents, slices, stash, table

CAPACITY = 2048
#: Width of a length bin and the most documents of a pattern.
BIN, MOST = 32, 4
#: Pieces of one length that are numbered together.
BUCKET_ROWS = 2_000
#: Words whose ids a worker remembers, in two generations.
REMEMBERED = 250_000
_MARK = "<|endoftext|>"
_BARE = re.compile(r"[a-zß-öø-ÿ]+|[!-/:-@\[-`{-~]+")
#: Bytes, read as Latin-1, in the characters by which a byte-level vocabulary spells them: those that print stand for themselves.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as little-endian bytes.  White space never joins two words of this vocabulary, so the ids
    of a text are the ids of its words.  Words met before come from memory.  Of a new word that is
    Latin letters and then marks, the letters (in lower case, as the vocabulary has it) and the marks
    are looked up apart, as its splitter parts them too.  What is still new goes to the vocabulary's model,
    or, if it has other characters, to the tokenizer together, parted by a special token that is cut out of a
    text before anything else."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.mark = self.tok.token_to_id(_MARK)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn_bare(self, missing: dict[bytes, str]) -> None:
        """Words of one kind of characters, which need no normalising or splitting: the model alone gives their ids."""
        tokenize = self.model.tokenize
        for key, word in missing.items():
            ids = [x.id for x in tokenize(word if word.isascii() else key.decode("latin-1").translate(_BYTES))]
            self.new[key] = struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, missing: list[str]) -> None:
        for at in range(0, len(missing), 4096):
            some = missing[at : at + 4096]
            ids = np.array(self.tok.encode_batch_fast([_MARK.join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            raw, start = ids.tobytes(), 0
            for w, stop in zip(some, [*cuts.tolist(), len(ids)], strict=True):
                self.new[w.encode("utf-8")] = raw[4 * start : 4 * stop]
                start = stop + 1

    def _add(self, words: set[bytes]) -> None:
        """Put words that ``new`` lacks into it.  Letters in lower case and marks are words too, so there is one memory."""
        split: list[tuple[bytes, bytes, bytes]] = []
        old, new, plain, bare = self.old.get, self.new, _PLAIN.fullmatch, _BARE.fullmatch
        unknown: dict[bytes, str] = {}
        others: dict[bytes, str] = {}

        def part(text: str) -> bytes:
            key = text.encode("utf-8")
            if key not in new:
                if (x := old(key)) is not None:
                    new[key] = x
                elif bare(text):
                    unknown[key] = text
                else:
                    others[key] = text
            return key

        for w in words:
            if (x := old(w)) is not None:
                new[w] = x
            elif w.isalpha():  # of ASCII letters
                if w.islower():
                    unknown[w] = w.decode()
                else:
                    split.append((w, part(w.lower().decode()), b""))
            else:
                text = w.decode("utf-8", "replace")
                m = plain(text)
                split.append((w, part(m[1].lower()), part(m[2]) if m[2] else b"") if m else (w, part(text), b""))
        if unknown:
            self._learn_bare(unknown)
        if others:
            self._learn(list(others.values()))
        for w, head, tail in split:
            new[w] = new[head] + new[tail] if tail else new[head]

    def many(self, texts: list[str]) -> list[bytes]:
        """New words of all texts are learned together: a call of the tokenizer costs as much as dozens of words."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        # a text with a special token, which may reach over anything, goes through the tokenizer whole
        split = [None if "<|" in t else t.encode("utf-8", "replace").split() for t in texts]
        if missing := set().union(*filter(None, split)).difference(self.new):
            self._add(missing)
        known, out = self.new.__getitem__, []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                ids = self.tok.encode(text, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                out.append(b"".join(map(known, words)))
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


#: Kept by a worker for its next task, until a task of another operator comes.
_encoders: dict[str, Encoder] = cache("packing")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for batch in slices(batches, owner="packing"):
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode.many(texts), strict=True):
                raw = ids + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def nnls(a: np.ndarray, b: np.ndarray, most: int = 400) -> np.ndarray:
    """min |a x - b|, x >= 0, by the active-set method on the normal equations."""
    ata, atb = a.T @ a, a.T @ b
    n = len(atb)
    x, active = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0)))
    for _ in range(most):
        grad = atb - ata @ x
        grad[active] = -np.inf
        j = int(grad.argmax()) if n else 0
        if n == 0 or grad[j] <= tol:
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            s = np.linalg.lstsq(ata[np.ix_(on, on)], atb[on], rcond=None)[0]
            if s.min() > 1e-12:
                x[:] = 0
                x[on] = s
                break
            bad = s <= 1e-12
            step = np.min(x[on][bad] / np.maximum(x[on][bad] - s[bad], 1e-300))
            x[on] += step * (s - x[on])
            drop = on[(x[on] <= 1e-12) & bad]
            if not len(drop):
                drop = on[bad][:1]
            x[drop] = 0
            active[drop] = False
            if not active.any():
                break
    return x


def patterns(bins: int, most: int = MOST) -> list[tuple[int, ...]]:
    """Multisets of 1 to ``most`` bin numbers (1..bins, descending) whose sum is ``bins``."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, top: int, have: tuple[int, ...]) -> None:
        if not left:
            out.append(have)
        elif len(have) < most:
            for x in range(min(left, top), 0, -1):
                if x * (most - len(have)) >= left:
                    grow(left - x, x, (*have, x))

    grow(bins, bins, ())
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = BIN) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats).  Every piece of the histogram is in it exactly once."""
    left = {n: c for n, c in histogram.items() if c}
    width = max(1, min(width, capacity))
    bins = capacity // width
    bin_of = lambda n: min(bins, -(-n // width))  # noqa: E731  rounded up: what fits in bins fits in tokens
    if capacity % width:
        bin_of = lambda n: -(-n // width) if n <= bins * width else 0
    h = np.zeros(bins + 1)
    for n, c in left.items():
        h[bin_of(n)] += c
    groups: list[list] = []  # [lengths, repeats]
    found = patterns(bins)
    a = np.zeros((bins, len(found)))
    for j, p in enumerate(found):
        for x in p:
            a[x - 1, j] += 1
    # a bin left over costs a sequence's share of its length: longer bins weigh more
    weight = np.sqrt(np.arange(1, bins + 1) / bins)
    x = nnls(a * weight[:, None], h[1:] * weight)
    by_bin: dict[int, list[int]] = {}
    lengths = sorted(left)
    for n in lengths:
        by_bin.setdefault(bin_of(n), []).append(n)
    for j in np.argsort(-x, kind="stable"):
        repeats = int(x[j] + 1e-6)
        while repeats:
            chosen: list[int] = []
            for k, b in enumerate(found[j]):
                if k and k == len(found[j]) - 1:  # the last fills exactly, as bins are rounded up
                    c = [n for n in lengths[: bisect_right(lengths, capacity - sum(chosen))] if left[n] > chosen.count(n)][-1:]
                else:
                    c = [n for n in by_bin.get(b, []) if left[n] > chosen.count(n)][-1:]
                if not c:
                    break
                chosen += c
            if len(chosen) < len(found[j]):
                break
            times = min([repeats, *(left[n] // chosen.count(n) for n in set(chosen))])
            for n in chosen:
                left[n] -= times
            groups.append([tuple(chosen), times])
            repeats -= times
    # the residual: best fit, longest first, into the gaps of groups that repeat alike
    gaps: dict[int, list[list]] = {}
    order: list[int] = []

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append([lengths, times])

    for group, times in groups:
        put(tuple(group), times)
    for n in sorted(left, reverse=True):
        while left[n]:
            i = bisect_left(order, n)
            if i == len(order):
                per = capacity // n
                full, rest = divmod(left[n], per)
                left[n] = 0
                if full:
                    put((n,) * per, full)
                if rest:
                    put((n,) * rest, 1)
                continue
            gap = order[i]
            have, times = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            # as many as the gap holds, if there are enough for all repeats of this group
            each = max(1, min(gap // n, left[n] // times))
            take = min(times, left[n] // each)
            left[n] -= take * each
            put(have + (n,) * each, take)
            if times > take:
                put(have, times - take)
    merged: dict[tuple[int, ...], int] = {}
    for alike in gaps.values():
        for have, times in alike:
            merged[have] = merged.get(have, 0) + times
    return sorted(merged.items(), reverse=True)


def ranges(packed: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): rank r of a length goes to sequence first + r - first rank."""
    out, used, sequence = [], {}, 0
    for lengths, times in packed:
        offset = 0
        for n in lengths:
            r = used.get(n, 0)
            out.append((n, r, times, sequence, offset))
            used[n] = r + times
            offset += n
        sequence += times
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ...) that are already stored."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    # a frequent length is numbered in sub-buckets of about BUCKET_ROWS
    # Arrow tables are local relations; lists of rows would go through workers of another kind, which then idle beside the others
    many = [c // BUCKET_ROWS + 1 for c in counts.values()]
    parts = spark.createDataFrame(pa.table({"length": pa.array(list(counts), pa.int64()), "__parts": pa.array(many, pa.int32())}))
    dealt = cut.join(F.broadcast(parts), "length").withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.col("__parts")).cast("int")).drop("__parts")
    sizes = dealt.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("length").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offset_df = sizes.select("length", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    histogram = dict(sorted(counts.items()))
    plan_rows = ranges(plan(histogram, capacity))
    first: dict[int, list[tuple]] = {}
    for n, r, times, seq, off in plan_rows:
        first.setdefault(n, []).append((r, times, seq, off))
    # bounded by the capacity and the number of groups of the plan, not by the corpus
    column = lambda k: pa.array([[x[k] for x in v] for v in first.values()], pa.list_(pa.int64()))
    plan_df = spark.createDataFrame(pa.table({"length": pa.array(list(first), pa.int64()), "__r": column(0), "__s": column(2), "__o": column(3)}))
    ranked = dealt.withColumn("__i", F.row_number().over(W.partitionBy("length", "__b").orderBy("doc_id", "piece", "start")) - 1)
    ranked = ranked.join(offset_df, ["length", "__b"]).withColumn("__rank", F.col("__before") + F.col("__i"))
    placed = ranked.join(F.broadcast(plan_df), "length")
    at = F.size(F.filter("__r", lambda r: r <= F.col("__rank")))
    return (
        placed.withColumn("__k", at)
        .withColumn("sequence_id", F.element_at("__s", F.col("__k")) + F.col("__rank") - F.element_at("__r", F.col("__k")))
        .withColumn("offset", F.element_at("__o", F.col("__k")))
        .drop("__b", "__i", "__before", "__rank", "__r", "__s", "__o", "__k")
    )


def best_fit_pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(stash(pieces(docs, path or tokenizer_path(), capacity)), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    return best_fit_pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
