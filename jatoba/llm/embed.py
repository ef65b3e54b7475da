"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised, and equal ones (component by component) are one class from here on, with a
count.  ``TABLES`` hash tables each quantise ``PROJECTIONS`` Gaussian projections to cells of width
``CELL``; vectors that share all cells of a table meet in a bucket.

1. Only (table, bucket, id) is dealt at first: a star of each bucket, and the stars join to clusters.
   Vectors alone in all their buckets end here.
2. Clusters of at most ``CLUSTER`` vectors are compared whole, in double precision, block by block; each
   vector is sent once, and small clusters share a group, whose number follows the rows.
3. Larger clusters are compared bucket by bucket.  A pair that meets in several tables counts in the
   first only.  A bucket larger than ``BLOCK`` becomes a triangle of block pairs, one group each, so
   memory stays bounded for a bucket of any size; the comparisons in one bucket of mutually near
   vectors still grow with its square, as every one of them is a link to be counted.

Links are summed where they are found and pairs never leave their task: a task sends per vector its
number of links, and a spanning forest of its links.  At cosine 0.95 a pair meets in at least one table
with probability above 0.999 (the tests measure recall against brute force).

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing and
are their own component; vectors of different lengths are never compared; equal rows link with one
another, also where their vec_id is equal; a row with a null vec_id has no links, counts as nobody's link and
has no component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import pick, stash, table
from .components import components

THRESHOLD, TABLES, PROJECTIONS, CELL, BLOCK, CLUSTER = 0.95, 24, 8, 1.6, 1024, 2048


def family(dim: int, tables: int, projections: int, cell: float, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * projections)), rng.uniform(0, cell, tables * projections)


def signatures(unit: np.ndarray, tables: int, projections: int, cell: float) -> np.ndarray:
    """One 64-bit bucket per vector and table."""
    a, b = family(unit.shape[1], tables, projections, cell)
    cells = np.floor((unit @ a + b) / cell).astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
    mults = np.random.default_rng(17).integers(1, 1 << 62, projections, dtype=np.uint64) | np.uint64(1)
    h = (cells * mults).sum(2, dtype=np.uint64)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack([np.asarray(r, float) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else the squares of very large or small components over- or underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: rep (the least id), copies, v."""
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    plain = vectors.filter(F.coalesce(ok, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0 is 0
    return plain.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))


class Links:
    """What a task found: links per class, and a spanning forest."""

    def __init__(self):
        self.links: dict[int, int] = {}
        self.forest: list[tuple[int, int]] = []
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, left: pd.DataFrame, right: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> None:
        """Rows a of ``left`` are linked with rows b of ``right``."""
        ra, rb, ca, cb = left["rep"].to_numpy(), right["rep"].to_numpy(), left["copies"].to_numpy(), right["copies"].to_numpy()
        for ids, n in ((ra, np.bincount(a, cb[b], len(ra))), (rb, np.bincount(b, ca[a], len(rb)))):
            for x in np.flatnonzero(n):
                self.links[int(ids[x])] = self.links.get(int(ids[x]), 0) + int(n[x])
        for x, y in zip(ra[a].tolist(), rb[b].tolist(), strict=True):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                self.forest.append((x, y))

    def frame(self) -> pd.DataFrame:
        ids = list(self.links)
        return pd.DataFrame({"rep": ids + [a for a, _ in self.forest], "links": [self.links[x] for x in ids] + [0] * len(self.forest), "other": pd.array([None] * len(ids) + [b for _, b in self.forest], "Int64")})


FOUND = "rep bigint, links bigint, other bigint"


def _blocks(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float, block: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]]:
    """Linked rows, block by block, of two sets of vectors of one length, or of one set with itself."""
    for at in range(0, len(left), block):
        x = left.iloc[at : at + block]
        ux = _unit(list(x["v"]))
        for bt in range(at if right is None else 0, len(left if right is None else right), block):
            same = right is None and at == bt
            y = x if same else (left if right is None else right).iloc[bt : bt + block]
            hit = ux @ (ux if same else _unit(list(y["v"]))).T >= threshold
            a, b = np.nonzero(np.triu(hit, 1) if same else hit)
            if len(a):
                yield x, y, a, b


def near(reps: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, projections: int = PROJECTIONS, cell: float = CELL, block: int = BLOCK, cluster: int = CLUSTER) -> DataFrame:
    """From stored (rep, copies, v): rows (rep, links, other). ``links`` counts linked rows (copies of linked
    classes); ``other`` is null or a linked class of the spanning forest."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                for at in range(0, len(part), 2000):
                    sub = part.iloc[at : at + 2000]
                    sig = signatures(_unit(list(sub["v"])), tables, projections, cell)
                    yield pd.DataFrame({"tab": np.tile(np.arange(tables), len(sub)), "bucket": sig.ravel(), "rep": np.repeat(sub["rep"].to_numpy(), tables)})

    narrow = stash(reps.select("rep", "v").mapInPandas(hashed, "tab int, bucket bigint, rep bigint"))
    sizes = stash(narrow.groupBy("tab", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("lead")).filter("n > 1"))
    stars = narrow.join(sizes, ["tab", "bucket"]).filter("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
    clusters = components(stars).withColumnRenamed("id", "rep")
    count = stash(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("rows")))
    rows = count.filter(F.col("rows") <= cluster).agg(F.sum("rows")).first()[0] or 0
    groups = max(8, rows // cluster)
    small = clusters.join(count.filter(F.col("rows") <= cluster), "component").select("rep", "component", F.pmod(F.xxhash64("component"), F.lit(groups)).alias("g"))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out = Links()
        for _, part in pdf.groupby("component", sort=False):
            for _, sub in part.groupby(part["v"].map(len), sort=False):
                for found in _blocks(sub, None, threshold, block):
                    out.add(*found)
        return out.frame()

    found = reps.join(small, "rep").groupBy("g").applyInPandas(whole, FOUND)
    if not count.filter(F.col("rows") > cluster).take(1):
        return found
    large = clusters.join(count.filter(F.col("rows") > cluster), "component").select("rep")
    met = narrow.join(large, "rep", "left_semi").join(sizes.drop("lead"), ["tab", "bucket"])
    # blocks of a large bucket: row of block x goes to all pairs (x, y) in order
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    pairs = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # small buckets share a group, so that groups are about a block of rows whatever their number
    shared = max(8, (sizes.filter(F.col("n") <= block).agg(F.sum("n")).first()[0] or 0) // block)
    i, j = F.least("own", "other"), F.greatest("own", "other")
    g = F.when(F.col("n") > block, F.xxhash64("tab", "bucket", i, j)).otherwise(F.pmod(F.xxhash64("tab", "bucket"), F.lit(shared)))
    keyed = pairs.select("rep", "tab", "bucket", "own", i.alias("i"), j.alias("j"), g.alias("g"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = Links()
        for (tab, _, i, j), part in pdf.groupby(["tab", "bucket", "i", "j"], sort=False):
            for _, sub in part.groupby(part["v"].map(len), sort=False):
                mine = sub["own"].to_numpy() == i
                for x, y, a, b in _blocks(sub[mine], None if i == j else sub[~mine], threshold, block):
                    if tab:  # counted in an earlier table?
                        sx, sy = (signatures(_unit(list(z["v"])), tables, projections, cell)[:, :tab] for z in (x, y))
                        new = np.concatenate([~(sx[a[k : k + 65536]] == sy[b[k : k + 65536]]).any(1) for k in range(0, len(a), 65536)])
                        a, b = a[new], b[new]
                    out.add(x, y, a, b)
        return out.frame()

    return found.unionByName(keyed.join(reps, "rep").groupBy("g").applyInPandas(compare, FOUND))


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, v) to (id, n_links, component)."""
    base = vectors.select("id", F.col("v").cast("array<double>").alias("v"))
    reps = stash(classes(base.filter("id is not null")))
    found = stash(near(reps, threshold))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    summary = (
        reps.join(counts, "rep", "left")
        .join(comps.withColumnRenamed("id", "rep"), "rep", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    plain = base.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    known = plain.filter("id is not null").join(summary, "v", "left").unionByName(plain.filter("id is null").select("v", "id", F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("component")))
    return known.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pick(table(spark, sf_dir, "embeddings"), vec_id="bigint", embedding="array<double>")
    linked = link(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    return linked.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
