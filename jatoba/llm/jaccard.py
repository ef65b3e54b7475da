"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows, exact recursion.

The Jaccard distance is a metric, so a pair within ``t`` of one another lies in the home region of
either of them, if a document is also copied to every pivot p with d(x, p) <= d(x, home) + 2 t.  With
whole documents as the pivots of a whole corpus this prunes nothing: nearly all distances are 1, and
every document is copied to every region.  So the first level takes pivots that are small sets:

1. A hash picks a share of all shingles, twice (1 - threshold), the same for all sets.  A linked set has
   at most m = n - ceil(threshold n) shingles that the other one has not, so at most m of its picked ones.
   Picked shingles are counted exactly; of a set with more than m picked shingles of its own nothing
   is sent on.  Else the m + 1 rarest are its pivots, and a region is all sets that have a pivot: the
   first common shingle, rarest first, is one of both.  The pick decides if either set has more than m picked
   shingles; small sets that have not also meet by all their shingles.  A bounded table of the most
   frequent shingles, ranked last, keeps those out of the count: no shingle brings very many rows to a task.
2. A region links its sets by chains over their sizes (sizes of linked sets differ by at most the
   threshold: the window of this level).  Each task chains its own sets first and sends one row a
   region and chain, so a region of any size costs its readers one row a task.
3. Chains join to clusters (no cluster is ever gathered to label it).  Every linked pair is inside one.
4. One common line chains short sets that are far apart, and such clusters grow faster than the table.  So a cluster
   that is too large for a task is dealt by parts first: its shingles fall into p = k + 1 + SLACK parts by a hash, where
   linked sets of these sizes differ in at most k shingles, so they have 1 + SLACK parts in common, of some nine
   shingles each.  Sets that share a part are compared; the parts of very many sets (copies of one text with
   changes) chain these to regions.  Parts without shingles count only in sets with more than SLACK of them.
5. These regions, which are near one another in text, are joined by Voronoi regions over document
   pivots, as above, again and again while a region is too large for a task.  Sets linked with a pivot
   are connected through it, so only pairs with a set that is not (a loose one) are left to do: a region
   without loose sets is done, and one that does not shrink becomes a grid of pairs of blocks, one
   of them loose.
6. In a region that fits, links are exact: pivots link what is within t of them, their distances
   rule out pairs that differ by more than t (triangle inequality), and a prefix index, rarest shingle
   first, proposes the other pairs.  Pairs already connected are not computed again: the result is
   components.

Equal sets are one class from the start, named by a 128-bit sum over shingle hashes (shingles are
64-bit hashes), so copies are never paired.  Candidates (1 to 3) go by the first half of the name: sets
that share it by chance only meet in a cluster, links and components go by the whole name.

Edge cases: null and empty texts, and texts without words, have the empty set and link with nothing,
not with one another; fewer words than a shingle are one shingle; rows that repeat are links of one
another; a null doc_id belongs to the class of its text and is never the least id of it; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import hashing
from .common import discard, documents, slices, small, stash, table
from .components import components
from .scan import folded

SHINGLE, NUM, DEN = 3, 9, 10  # threshold NUM / DEN
#: Sets that one task joins at once, and their shingles; the most bits of the filter of clustered sets.
REGION_SETS, REGION_SHINGLES, FILTER_BITS = 2000, 2_000_000, 1 << 26
PIVOTS, DEPTH = 64, 3
#: Parts of a set that may be empty without being shared.
SLACK = 2
#: Shingles that are known to be frequent (they are sent to all tasks), and the rows a task sorts at once.
FREQUENT, BUFFER = 1 << 17, 1 << 18
#: Bytes of text hashed at once: a byte costs some 40 in arrays while it is.
HASHED_BYTES = 1 << 18
#: Rows of one class that are joined with its name apart from all others (or a ten-thousandth of all rows, if that is more).
HOT_ROWS = 4096


def set_hashes(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    w = hashing.words(batch.column("text"), lower=True)
    grams = hashing.grams(w.hashes, k)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield hashing.grams(w.hashes[a:b], b - a) + np.uint64(b - a)
        else:
            yield w.hashes[:0]


def signature(h: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums; only of sets that aren't empty."""
    x = hashing.mix(h ^ np.uint64(0xA0761D6478BD642F))
    y = hashing.mix(h + np.uint64(0xE7037ED1A0B428DB))
    s = np.array([x.sum(dtype=np.uint64), y.sum(dtype=np.uint64)], np.uint64)
    return tuple(hashing.mix(s).view(np.int64).tolist())


def names(s1: np.ndarray, s2: np.ndarray) -> pa.Array:
    """The two halves of signatures as one binary column."""
    both = np.stack([s1, s2], 1).astype("<i8")
    return pa.Array.from_buffers(pa.binary(), len(both), [None, pa.py_buffer(np.arange(0, 16 * len(both) + 1, 16, dtype=np.int32)), pa.py_buffer(both.tobytes())])


def classes(docs: DataFrame, k: int) -> DataFrame:
    """Add n and id (null without words) to the rows of ``docs``, whose text goes."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=HASHED_BYTES):
            sets = list(set_hashes(batch, k))
            n = np.array([len(h) for h in sets], np.int64)
            sig = np.array([signature(h) if len(h) else (0, 0) for h in sets], np.int64).reshape(-1, 2)
            ids = pc.if_else(pa.array(n > 0), names(sig[:, 0], sig[:, 1]), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n), ids], [*kept, "n", "id"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{schema}n bigint, id binary")


def _distinct_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """(signature, hashes) of the sets of a task, each once."""
    seen: set[tuple[int, int]] = set()
    for batch in slices(batches, limit=HASHED_BYTES):
        for h in set_hashes(batch, k):
            if len(h) and (s := signature(h)) not in seen:
                seen.add(s)
                yield s, h


def spare(n: int, num: int, den: int) -> int:
    """The most shingles a set of n can have that a linked one has not."""
    return n - (num * n + den - 1) // den


def picked(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """The picked shingles of a set (sorted hashes): those below a bound."""
    share = min(den, 2 * (den - num))
    return h if share == den else h[: np.searchsorted(h, np.uint64((1 << 64) // den * share))]


def frequent(docs: DataFrame, k: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, of the picked shingles most sets have, and their rank (rarest 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= 4
            return pa.RecordBatch.from_arrays([pa.array(hashing.signed(v[often])), pa.array(c[often])], ["v", "c"])

        for _, h in _distinct_sets(batches, k):
            x = picked(h, num, den)
            held.append(x if len(x) > spare(len(h), num, den) else h)
            total += len(held[-1])
            if total > BUFFER:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    counts = docs.select("text").mapInArrow(run, "v bigint, c bigint").groupBy("v").agg(F.sum("c").alias("c"))
    top = counts.orderBy(F.col("c").desc(), "v").limit(FREQUENT).toPandas()
    v, c = top["v"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(v)
    v, c = v[order], c[order]
    rank = np.empty(len(v), np.int64)
    rank[np.lexsort((v, c))] = np.arange(len(v))
    return v, rank


def _chains(region: np.ndarray, low: np.ndarray, high: np.ndarray, num: int, den: int) -> np.ndarray:
    """For rows in order of (region, low), whether a row begins a chain: no set before it in its region
    is large enough to link with it."""
    group = np.cumsum(np.concatenate([[0], (region[1:] != region[:-1]).astype(np.int64)]))
    top = np.maximum.accumulate(group * (1 << 40) + high) - group * (1 << 40)
    new = np.ones(len(region), bool)
    new[1:] = (group[1:] != group[:-1]) | (num * low[1:] > den * top[:-1])
    return new


CHAINS = "region bigint, low bigint, high bigint, a bigint, b bigint"
_CHAINS = pa.schema([("region", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def chain_rows(sets: Iterator[tuple[int, int, np.ndarray]], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """From (half name, size, pivots) of the sets of a task: one row a region and chain, and the edges inside chains."""
    held: list[tuple[int, int, np.ndarray]] = []
    total = 0

    def flush() -> Iterator[pa.RecordBatch]:
        region = hashing.signed(np.concatenate([p for *_, p in held]))
        who = np.repeat(np.arange(len(held)), [len(p) for *_, p in held])
        sizes = np.array([n for _, n, _ in held], np.int64)
        s = np.array([x for x, *_ in held], np.int64)
        held.clear()
        order = np.lexsort((who, sizes[who], region))
        region, who = region[order], who[order]
        n = sizes[who]
        first = np.flatnonzero(_chains(region, n, n, num, den))
        last = np.concatenate([first[1:], [len(n)]]) - 1
        lead = np.repeat(who[first], last - first + 1)
        pairs = np.unique(np.stack([lead, who], 1)[lead != who], axis=0)
        if len(pairs):
            a, b = s[pairs[:, 0]], s[pairs[:, 1]]
            none = np.full(len(pairs), -1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, none, none, a, b)], schema=_CHAINS)
        by = np.argsort(who[first], kind="stable")  # rows of one set lie together, so they compress
        first, last = first[by], last[by]
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (region[first], n[first], n[last], s[who[first]])), pa.nulls(len(first), pa.int64())], schema=_CHAINS)

    for row in sets:
        if len(row[2]):
            held.append(row)
            total += len(row[2])
        if total > BUFFER:
            yield from flush()
            total = 0
    if held:
        yield from flush()


def chain_edges(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) from the rows of all tasks: chains of a region that touch become one."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted; a chain may go on in the next batch, so it is carried over as one row."""
        carry: pa.RecordBatch | None = None
        out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            inside = pc.is_valid(batch.column("b"))
            done = batch.filter(inside)
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column("a"), done.column("b")], schema=out)
            rows = batch.filter(pc.invert(inside))
            if not rows.num_rows:
                continue
            if carry is not None:
                rows = pa.Table.from_batches([carry, rows]).combine_chunks().to_batches()[0]
            region, low, high = (rows.column(c).to_numpy() for c in ("region", "low", "high"))
            new = _chains(region, low, high, num, den)
            first = np.flatnonzero(new)
            lead = first[np.cumsum(new) - 1]
            member = np.flatnonzero(lead != np.arange(len(lead)))
            pairs = pa.table([rows.column("a").take(pa.array(lead[member])), rows.column("a").take(pa.array(member))], schema=out)
            pairs = pairs.filter(pc.not_equal(pairs["a"], pairs["b"])).group_by(["a", "b"]).aggregate([])
            yield from pairs.to_batches()
            at = pa.array(first[-1:])
            top = pa.array([int(high[first[-1] :].max())])
            carry = pa.RecordBatch.from_arrays([rows.column("region").take(at), rows.column("low").take(at), top, rows.column("a").take(at), rows.column("b").take(at)], schema=_CHAINS)

    dealt = rows.repartition("region").sortWithinPartitions("region", "low")
    return dealt.mapInArrow(runs, "a bigint, b bigint").distinct()


_ALL = np.uint64(0x3C6EF372FE94F82B)  # marks the rows of sets that meet by all their shingles


def stars(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Candidate edges (a, b) between sets of one region: each member of a chain with the chain's first."""
    often, rank = frequent(docs, k, num, den)
    rows = pa.schema([("s1", pa.int64()), ("v", pa.int64()), ("about", pa.binary())])
    counted = pa.schema([("s1", pa.int64()), ("c", pa.int64()), ("v", pa.int64()), ("about", pa.binary())])

    def parted(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles to be counted, and the frequent ones that may be pivots."""
        if not len(often):
            return x, x[:0]
        at = np.minimum(np.searchsorted(often, x), len(often) - 1)
        of = often[at] == x
        return x[~of], x[of][np.argsort(rank[at[of]])[: m + 1]]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(s1, v) of shingles, and (name, its hash, about) of sets: s1, n, shingles counted, and frequent ones that may be pivots."""
        ids, counts, vs, abouts, total = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            names_, v = np.array(ids, np.int64), np.concatenate(vs)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names_, counts)), pa.array(hashing.signed(v)), pa.nulls(len(v), pa.binary())], schema=rows)
            yield pa.RecordBatch.from_arrays([pa.array(names_), pa.array(hashing.signed(hashing.mix(names_.view(np.uint64)))), pa.array(abouts, pa.binary())], schema=rows)
            for x in (ids, counts, vs, abouts):
                x.clear()

        def add(s1: int, n: int, v: np.ndarray, last: np.ndarray, own: int) -> None:
            ids.append(s1)
            counts.append(len(v))
            vs.append(v)
            abouts.append(np.concatenate([np.array([own, n, len(v)], np.int64), hashing.signed(last)]).astype("<i8").tobytes())

        for (s1, _), h in _distinct_sets(batches, k):
            m = spare(len(h), num, den)
            x = picked(h, num, den)
            if len(x):
                add(s1, len(h), *parted(x, m), s1)
            if len(x) <= m:
                v, last = parted(h, m)
                other = int((np.array([s1], np.int64).view(np.uint64) ^ _ALL).view(np.int64)[0])
                add(other, len(h), hashing.mix(v ^ _ALL), hashing.mix(last ^ _ALL), s1)
                total += len(h)
            total += len(x)
            if total > BUFFER // 2:
                yield from flush()
                total = 0
        if ids:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(s1, c, v) of shingles that c > 1 sets have, and sets as they are.  Rows arrive sorted; copies of a set in
        several tasks repeat rows."""
        v0, s0 = np.empty(0, np.int64), np.empty(0, np.int64)

        def told(v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1])
            v, s = v[new], s[new]
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
            c = np.diff(np.concatenate([first, [len(v)]]))
            c = np.repeat(c, c)
            return pa.RecordBatch.from_arrays([pa.array(x[c > 1]) for x in (s, c, v)] + [pa.nulls(int((c > 1).sum()), pa.binary())], schema=counted)

        for batch in batches:
            of_set = pc.is_valid(batch.column("about"))
            sets = batch.filter(of_set)
            if sets.num_rows:
                zero = pa.array(np.zeros(sets.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([sets.column("s1"), zero, zero, sets.column("about")], schema=counted)
            batch = batch.filter(pc.invert(of_set))
            if batch.num_rows:
                v, s = np.concatenate([v0, batch.column("v").to_numpy()]), np.concatenate([s0, batch.column("s1").to_numpy()])
                end = np.searchsorted(v, v[-1])  # the last shingle may go on in the next batch
                if end:
                    yield told(v[:end], s[:end])
                v0, s0 = v[end:], s[end:]
        yield told(v0, s0)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[int, int, np.ndarray]]:
            """Rows arrive by set, what is said about it first, then its shingles, rarest first."""
            s1, about, held = None, None, []

            def done() -> tuple[int, int, np.ndarray]:
                own, n, sent = about[:3].tolist()
                v = np.concatenate(held).view(np.uint64)
                pivots = spare(n, num, den) + 1 - (sent - len(v))
                return own, n, np.concatenate([v, about[3:].view(np.uint64)])[: max(pivots, 0)]

            for batch in batches:
                ids, v, tells = batch.column("s1").to_numpy(), batch.column("v").to_numpy(), batch.column("about")
                starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else []
                for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                    if ids[a] != s1:
                        if s1 is not None:
                            yield done()
                        s1, about, held = ids[a], None, []
                    while a < b and tells[a].is_valid:  # once a task that has the set
                        about, a = np.frombuffer(tells[a].as_py(), "<i8"), a + 1
                    held.append(v[a:b])
            if s1 is not None:
                yield done()

        return chain_rows(groups(), num, den)

    dealt = docs.select("text").mapInArrow(spread, "s1 bigint, v bigint, about binary").repartition("v").sortWithinPartitions("v", "s1")
    by_set = dealt.mapInArrow(count, "s1 bigint, c bigint, v bigint, about binary").repartition("s1").sortWithinPartitions("s1", "c", "v")
    return chain_edges(by_set.mapInArrow(keys, CHAINS), num, den)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, 16 bits an id but never more than FILTER_BITS, so that it can be sent
    everywhere.  It only saves shuffling: what passes it is joined by id."""
    bits = 1 << 16
    want = 16 * ids.count()
    while bits < min(want, FILTER_BITS):
        bits *= 2
    pages, size = 64, bits // 8 // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits, bool)
        for batch in batches:
            if batch.num_rows:
                bitmap[_slot(batch.column("id").to_numpy(), bits)] = True
        packed = np.packbits(bitmap).reshape(pages, size)
        hit = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array([packed[p].tobytes() for p in hit], pa.binary())], ["part", "v"])

    out = np.zeros((pages, size), np.uint8)
    for r in folded(ids.select("id").mapInArrow(run, "part int, v binary"), np.bitwise_or, "u1").collect():
        out[r["part"]] = np.frombuffer(r["v"], np.uint8)
    return out.ravel()


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (hashing.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def members(docs: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """(cluster, s1, id, h, task) of clustered sets; copies in several tasks repeat a row."""
    packed = id_filter(clusters)
    bits = len(packed) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[tuple[tuple[int, int], np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            s = np.array([x for x, _ in held], np.int64)
            flat = hashing.signed(np.concatenate([h for _, h in held]))
            ends = np.concatenate([[0], np.cumsum([len(h) for _, h in held])]).astype(np.int32)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(s[:, 0]), names(*s.T), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.full(len(s), task), pa.int32())], ["s1", "id", "h", "task"])

        for s, h in _distinct_sets(batches, k):
            i = int(_slot(np.array(s[:1], np.int64), bits)[0])
            if packed[i >> 3] >> (7 - (i & 7)) & 1:
                held.append((s, h))
                total += len(h)
            if total > BUFFER // 4:
                yield flush()
                total = 0
        if held:
            yield flush()

    sets = docs.select("text").mapInArrow(run, "s1 bigint, id binary, h array<bigint>, task int")
    return sets.join(small(clusters.select(F.col("id").alias("s1"), F.col("component").alias("cluster"))), "s1").select("cluster", "s1", "id", "h", "task")


# ---- joining a region that fits --------------------------------------------------------------------


def _array(scalar: pa.ListScalar) -> np.ndarray:
    """The numbers of a list cell, without Python objects."""
    return scalar.values.to_numpy(zero_copy_only=False).view(np.uint64)


def _jaccard(x: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Similarity of one set with many."""
    if not sets:
        return np.empty(0)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    i = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    inter = np.add.reduceat((x[i] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return inter / (len(x) + sizes - inter)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return den * inter >= num * (len(x) + len(y) - inter)


def join_region(ids: list[bytes], sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None, core: np.ndarray | None = None) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links among sets.  With ``side`` (0 or 1), only what links across counts; sets in
    ``core`` are connected already."""
    n = len(ids)
    t = 1 - num / den + 1e-12
    root = list(range(n))
    forest: list[tuple[bytes, bytes]] = []

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    def unite(a: int, b: int) -> None:
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            forest.append((ids[a], ids[b]))

    if core is not None and core.any():
        inner = np.flatnonzero(core).tolist()
        for j in inner:
            root[j] = inner[0]

    # pivots: what is within t of one is linked to it; distances serve as windows below
    far: list[np.ndarray] = []
    for p in np.linspace(0, n - 1, min(16, max(1, n // 8))).astype(int) if n > 8 else ():
        d = 1 - _jaccard(sets[p], sets)
        for j in np.flatnonzero(d <= t):
            if j != p and linked(sets[p], sets[j], num, den):
                unite(int(p), int(j))
        far.append(d)
    to_pivots = np.stack(far, 1) if far else np.zeros((n, 1))
    # rarest shingle first; a linked pair shares one of the first n - ceil(threshold n) + 1
    values, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    index: dict[int, list[int]] = {}
    sizes = np.array([len(s) for s in sets])
    local = np.split(where, cuts)
    for j in np.argsort(sizes, kind="stable").tolist():
        c = count[local[j]]
        keep = sizes[j] - (num * sizes[j] + den - 1) // den + 1
        prefix = local[j][np.lexsort((local[j], c))[:keep]].tolist()
        met: set[int] = set()
        for v in prefix:
            for i in index.get(v, ()):
                met.add(i)
        if met:
            m = np.fromiter(met, np.int64, len(met))
            ok = (den * sizes[m] >= num * sizes[j]) & (np.abs(to_pivots[m] - to_pivots[j]) <= t).all(1)
            if side is not None:
                ok &= side[m] != side[j]
            for i in m[ok].tolist():
                if find(i) != find(j) and linked(sets[i], sets[j], num, den):
                    unite(i, j)
        for v in prefix:
            index.setdefault(v, []).append(j)
    return forest


def _frame(pairs: list[tuple[bytes, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(pairs, columns=["a", "b"], dtype=object)


class Pivots:
    """The pivots of a region: distances of a set to all of them at once, and what links them."""

    def __init__(self, ids: list[bytes], sets: list[np.ndarray], num: int, den: int):
        self.ids, self.sizes, self.num, self.den = ids, np.array([len(x) for x in sets]), num, den
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.links = join_region(ids, sets, num, den)
        at = {x: i for i, x in enumerate(ids)}
        self.root = np.arange(len(ids))
        for a, b in self.links:  # few pivots: relabel
            p, q = self.root[at[a]], self.root[at[b]]
            self.root[self.root == max(p, q)] = min(p, q)

    def shared(self, x: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.flat, x, "left"), np.searchsorted(self.flat, x, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.ids))


def _fits(rows: DataFrame) -> DataFrame:
    """Regions that have pairs to compare, their sizes, and whether they fit a task."""
    once = rows.select("region", "id", "core", F.size("h").alias("s")).distinct()
    of = lambda c, v: F.sum(F.when(c, v).otherwise(0))
    sums = [of(F.col("core"), F.lit(1)).alias("core_sets"), of(F.col("core"), F.col("s")).alias("core_shingles"), of(~F.col("core"), F.lit(1)).alias("loose_sets"), of(~F.col("core"), F.col("s")).alias("loose_shingles")]
    fits = (F.col("core_sets") + F.col("loose_sets") <= REGION_SETS) & (F.col("core_shingles") + F.col("loose_shingles") <= REGION_SHINGLES)
    return once.groupBy("region").agg(*sums).filter("loose_sets > 0").withColumn("fits", fits)


def join_regions(rows: DataFrame, num: int, den: int, depth: int = DEPTH) -> DataFrame:
    """Links (a, b) inside regions of (region, id, h, core): with the connections of core sets, a spanning
    forest of each."""
    t = 1 - num / den

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id")
        return _frame(join_region(pdf["id"].tolist(), [np.asarray(h).view(np.uint64) for h in pdf["h"]], num, den, None, pdf["core"].to_numpy(bool)))

    sizes = stash(_fits(rows))
    fitting = rows.join(small(sizes.filter("fits").select("region")), "region", "left_semi")
    found = fitting.groupBy("region").applyInPandas(whole, "a binary, b binary")
    large = sizes.filter("not fits").drop("fits")
    if not large.take(1):
        return found
    big = stash(rows.select("region", "id", "h").join(small(large), "region").dropDuplicates(["region", "id"]))
    # pivots: the PIVOTS sets of each large region that a hash puts first; every part of a region gets them first
    parts = F.ceil(F.greatest((F.col("core_sets") + F.col("loose_sets")) / REGION_SETS, (F.col("core_shingles") + F.col("loose_shingles")) / REGION_SHINGLES)).cast("int")
    chosen = big.join(_first(big.select("region", "id", F.xxhash64("region", "id").alias("o"))), ["region", "id"], "left_semi")
    sent = chosen.select("region", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("turn"), "id", "h")
    dealt = big.select("region", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(1).alias("turn"), "id", "h").unionByName(sent)
    schema = pa.schema([("parent", pa.int64()), ("k", pa.int32()), ("id", pa.binary()), ("h", pa.list_(pa.int64())), ("core", pa.bool_()), ("root", pa.int32()), ("other", pa.binary())])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A set in all regions its window touches (k >= 0, its own first), and links with pivots (other)."""
        place, pivots, waiting = None, None, []
        for batch in batches:
            parent, part, turn, ids, sets = (batch.column(n) for n in ("region", "part", "turn", "id", "h"))
            rows, ks, cores, roots, links = [], [], [], [], []
            for i, (r, q, w) in enumerate(zip(parent.to_pylist(), part.to_pylist(), turn.to_pylist(), strict=True)):
                if (r, q) != place:
                    place, pivots, waiting = (r, q), None, []
                if w == 0:
                    waiting.append((ids[i].as_py(), _array(sets[i]).copy()))
                    continue
                if pivots is None:
                    waiting.sort(key=lambda x: x[0])
                    pivots = Pivots([a for a, _ in waiting], [b for _, b in waiting], num, den)
                    links += [(i, a, b) for a, b in pivots.links]
                x, name = _array(sets[i]), ids[i].as_py()
                both = pivots.shared(x)
                union = len(x) + pivots.sizes - both
                d = 1 - both / union
                near = np.flatnonzero(d <= d.min() + 2 * t + 1e-9)
                near = near[np.argsort(d[near], kind="stable")]
                joined = np.flatnonzero(den * both >= num * union)
                mine, at = np.unique(pivots.root[joined], return_index=True)
                links += [(i, pivots.ids[p], name) for p in joined[at] if pivots.ids[p] != name]
                rows += [i] * len(near)
                ks += near.tolist()
                cores += np.isin(pivots.root[near], mine).tolist()
                roots += [int(mine[0]) if len(mine) and j == 0 else -1 for j in range(len(near))]
                ks[-len(near)] = -1 - ks[-len(near)]  # its own region, told apart by the sign
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([parent.take(at), pa.array(ks, pa.int32()), ids.take(at), sets.take(at), pa.array(cores, pa.bool_()), pa.array(roots, pa.int32()), pa.nulls(len(rows), pa.binary())], schema=schema)
            if links:
                n = len(links)
                yield pa.RecordBatch.from_arrays([parent.take(pa.array([i for i, *_ in links])), pa.nulls(n, pa.int32()), pa.array([a for _, a, _ in links], pa.binary()), pa.nulls(n, schema.field("h").type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int32()), pa.array([b for *_, b in links], pa.binary())], schema=schema)

    ordered = dealt.repartition("region", "part").sortWithinPartitions("region", "part", "turn")
    below = stash(ordered.mapInArrow(home, "parent bigint, k int, id binary, h array<bigint>, core boolean, root int, other binary"))
    found = found.unionByName(below.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    next_rows = below.filter("other is null").select(F.xxhash64("parent", F.when(F.col("k") < 0, -1 - F.col("k")).otherwise(F.col("k"))).alias("region"), "parent", "id", "h", "core")
    # a region that has not lost a quarter of its parent's sets will not shrink further: the parent becomes a grid
    total = large.select(F.col("region").alias("parent"), (F.col("core_sets") + F.col("loose_sets")).alias("sets"))
    grown = next_rows.groupBy("region", "parent").agg(F.count(F.lit(1)).alias("c"), F.max(~F.col("core")).alias("open")).filter("open").join(total, "parent")
    stuck = stash(grown.groupBy("parent").agg(F.max(F.col("c") / F.col("sets")).alias("share")).filter("share > 0.75" if depth else "true").select("parent"))
    if stuck.take(1):
        own = below.filter("other is null and k < 0").join(stuck, "parent", "left_semi")
        counts = own.filter("root >= 0").groupBy("parent", "root").agg(F.count(F.lit(1)).alias("c"))
        best = counts.groupBy("parent").agg(F.max(F.struct("c", "root"))["root"].alias("best"))
        flagged = own.join(best, "parent", "left").select(F.col("parent").alias("region"), "id", "h", F.coalesce(F.col("root") == F.col("best"), F.lit(False)).alias("core"))
        found = found.unionByName(_grid(flagged, _fits(flagged), num, den))
    on = next_rows.join(stuck, "parent", "left_anti").select("region", "id", "h", "core")
    return found.unionByName(join_regions(on, num, den, depth - 1)) if depth and on.take(1) else found


def _first(choice: DataFrame) -> DataFrame:
    return choice.withColumn("r", F.row_number().over(W.partitionBy("region").orderBy("o", "id"))).filter(F.col("r") <= PIVOTS).select("region", "id")


def _grid(rows: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of blocks of (region, id, h, core) of which one is loose: each task holds two blocks,
    whatever the region's size."""
    blocks = lambda c: F.ceil(F.greatest(2 * F.col(f"{c}_sets") / REGION_SETS, 2 * F.col(f"{c}_shingles") / REGION_SHINGLES)).cast("int")
    at = rows.join(sizes.select("region", blocks("core").alias("cores"), blocks("loose").alias("looses")), "region")
    at = at.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("looses"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    own = F.col("own")
    across = F.when(F.col("cores") > 0, F.transform(upto(F.greatest("cores", F.lit(1))), lambda c: pair(1, c, own))).otherwise(F.array().cast("array<struct<kind:int,i:int,j:int>>"))
    places = F.when(F.col("core"), F.transform(upto(F.col("looses")), lambda x: pair(1, own, x))).otherwise(F.concat(F.transform(upto(F.col("looses")), lambda x: pair(0, F.least(own, x), F.greatest(own, x))), across))
    keyed = at.select("region", "core", "own", "id", "h", F.explode(places).alias("p")).select("region", "p.kind", "p.i", "p.j", "core", "own", "id", "h")

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id")
        kind, i, j = pdf[["kind", "i", "j"]].iloc[0]
        core = pdf["core"].to_numpy(bool)
        side = core.astype(int) if kind else None if i == j else (pdf["own"] == j).to_numpy().astype(int)
        return _frame(join_region(pdf["id"].tolist(), [np.asarray(h).view(np.uint64) for h in pdf["h"]], num, den, side, core))

    return keyed.groupBy("region", "kind", "i", "j").applyInPandas(both, "a binary, b binary")


def schemes(longest: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Least sizes of size classes, and the parts of pairs whose smaller set is in a class; linked sets are in one class
    or in neighbouring ones."""
    least = [1]
    while least[-1] <= longest:
        least.append(least[-1] * den // num + 1)
    least.append(least[-1] * den // num + 1)
    b = np.array(least, np.int64)
    small_, large_ = b[1:-1] - 1, np.minimum((b[1:-1] - 1) * den // num, b[2:] - 1)
    return b[:-2], (den - num) * (small_ + large_) // (den + num) + 1 + SLACK


def part_keys(h: np.ndarray, of: int, parts: np.ndarray) -> np.ndarray:
    """Hashes that name the parts of a set of size class ``of``, as the smaller and as the larger set of a pair."""
    x, out = hashing.mix(h ^ np.uint64(0x8EBC6AF09C88C6E3)), []
    for k in range(max(of - 1, 0), of + 1):
        p = int(parts[k])
        at = (x % np.uint64(p)).astype(np.int64)
        sums = np.zeros(p, np.uint64)
        np.add.at(sums, at, hashing.mix(x))
        named = hashing.mix(sums ^ hashing.mix(np.arange(p, dtype=np.uint64) + np.uint64(k << 32)))
        full = np.bincount(at, minlength=p) > 0
        out.append(named if p - full.sum() > SLACK else named[full])
    return np.concatenate(out)


def by_parts(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(region, id, h, core) of large clusters' sets (region, id, h): regions that hold every linked pair, see 4 above."""
    longest = rows.agg(F.max(F.size("h"))).first()[0]
    least, parts = schemes(longest, num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [_array(x) for x in batch.column("h")]
            keys = [part_keys(x, int(np.searchsorted(least, len(x), "right")) - 1, parts) for x in sets]
            n = [len(k) for k in keys]
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), pa.array(hashing.signed(np.concatenate(keys))), pa.array(np.repeat([len(x) for x in sets], n), pa.int64())], ["id", "part", "n"])

    keys = stash(rows.select("id", "h").mapInArrow(run, "id binary, part bigint, n bigint"))
    counts = stash(keys.groupBy("part").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first")).filter("c > 1"))
    most = REGION_SETS // 8
    many = counts.filter(F.col("c") > most)
    joined = components(keys.join(small(many), "part").select(F.col("first").alias("a"), F.col("id").alias("b")))
    together = rows.join(small(joined), "id").select(F.xxhash64("component").alias("region"), "id", "h", F.lit(False).alias("core"))
    few = keys.join(counts.filter(F.col("c") <= most).select("part"), "part").join(small(joined), "id", "left")
    # a part whose sets are in one region anyway says nothing new
    told = few.groupBy("part").agg(F.min(F.coalesce("component", "id")).alias("x"), F.max(F.coalesce("component", "id")).alias("y")).filter("x <> y").select("part")
    few = stash(few.join(told, "part", "left_semi").select("id", "part", "n"))
    n, shingles = few.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bundles = 1 + max(4 * n // REGION_SETS, 4 * shingles // REGION_SHINGLES)  # parts of all kinds share a task
    bundled = few.select(F.xxhash64(F.lit("parts"), F.pmod("part", F.lit(bundles))).alias("region"), "id").distinct()
    out = stash(together.unionByName(bundled.join(rows.select("id", "h"), "id").select("region", "id", "h", F.lit(False).alias("core"))))
    discard(keys, counts, joined, few)
    return out


def clustered(docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(id, component): sets that link with others, by a name of their component."""
    clusters = components(stars(docs, shingle, num, den))
    found = stash(members(docs, clusters, shingle))
    discard(clusters)
    # of the rows of one set the least task's stays; a stored list of names is joined, so sets need no shuffle while it is small
    repeated = stash(found.groupBy("id").agg(F.min("task").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"))
    rows = found.join(small(repeated), "id", "left").filter("first is null or task = first").select(F.xxhash64("cluster").alias("region"), "id", "h", F.lit(False).alias("core"))
    sizes = stash(_fits(rows))
    large = sizes.filter("not fits").select("region")
    if large.take(1):
        big = stash(rows.join(small(large), "region", "left_semi").select("region", "id", "h"))
        rows = rows.join(small(large), "region", "left_anti").unionByName(by_parts(big, num, den))
    links = components(join_regions(rows, num, den))
    discard(found, repeated)
    return links


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of links at Jaccard num / den or more."""
    labels = clustered(docs, shingle, num, den)
    rows = stash(classes(docs.select("doc_id", "text"), shingle))
    least = rows.filter("n > 0").groupBy("id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    joined = least.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    whole = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = stash(joined.join(whole, "component").select("id", "component_id", "rows"))
    # the classes of very many rows (few, whatever the table's size) are joined apart, so no task gets all their rows
    most = max(HOT_ROWS, rows.count() // 10_000)
    hot = by_class.filter(F.col("rows") > most)
    tell = lambda part, names: part.join(names.drop("rows"), "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    rest = rows.join(F.broadcast(hot.select("id")), "id", "left_anti")
    return tell(rest, by_class.filter(F.col("rows") <= most)).unionByName(rows.join(F.broadcast(hot), "id").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row of each component of ``docs``, with all columns: the least doc_id (a null one comes last),
    of one id the least hash of the text, of rows that repeat any one.  Rows without words stay.

    Rows are told apart by (doc_id, md5 of the text), so texts are not shuffled but for rows that repeat."""
    labels = clustered(docs, shingle, num, den)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    rows = stash(classes(docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("t"), "text"), shingle).filter("n > 0"))
    first = rows.groupBy("id").agg(F.min(key).alias("key"))
    joined = first.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    whole = joined.groupBy("component").agg(F.min("key").alias("stays"))
    stays = stash(joined.join(whole, "component").groupBy("stays").agg(F.count(F.lit(1))).select("stays.doc_id", "stays.t"))
    counted = rows.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("rows"))
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["t"] == y["t"])
    gone = stash(counted.join(stays, same(counted, stays), "left_anti").select(F.col("doc_id").alias("__doc"), F.col("t").alias("__text")))
    twice = stash(counted.filter("rows > 1").join(stays, same(counted, stays), "left_semi").select(F.col("doc_id").alias("__doc"), F.col("t").alias("__text")))
    discard(labels, rows)
    is_in = lambda x: docs["doc_id"].eqNullSafe(x["__doc"]) & (F.unhex(F.md5(docs["text"].cast("binary"))) == x["__text"])
    kept = docs.join(small(gone), is_in(gone), "left_anti")
    if not twice.take(1):
        return kept
    once = docs.join(small(twice), is_in(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small(twice), is_in(twice), "left_anti").unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(table(spark, sf_dir, "documents")))
