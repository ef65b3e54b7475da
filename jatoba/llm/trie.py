"""Prefix trie of conversations by preorder intervals.

A node is a distinct sequence of first turns.  It is named by its depth and the exclusive or of 120-bit hashes of
(turn, place) along it, which is associative: names come from distributed prefix totals over all turns, so a conversation
may have any number of them.

1. Turns are numbered, and named, by two prefix scans (``scan``).
2. Nodes are the distinct names, counted with map-side combining, so a first turn that a third of all conversations
   shares is one row a task.
3. The leaves are ranked in lexicographic order of their paths, of which only the turns below nodes with several children
   are compared.  Nodes sorted by (rank of the first leaf below, depth) stand in preorder; the subtree of a node ends with the
   last leaf below it.
4. Prefix sums over preorder give leaves and savings of a subtree as the difference between its end and its start.
5. The conversations that end at a node are joined to text in pieces by ranges, then hashed in order as a stream.

Edge cases: rows without a conversation id are left out; a null turn comes first and a null role or text is empty; turns of
the same number are ordered by a hash of their content, and rows that repeat are turns of their own; conversations
without turns count at the root; very long texts are one hash; an empty table has no nodes, not even the root; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import discard, pick, small, stash, table
from .resample import CRC_TABLE, crc_sql
from .scan import scan

#: Conversations of one family share the first turns of the first of them, at most ``BORROWED`` - 1.
FAMILY, BORROWED = 20, 4
#: Bytes of one piece of a list of ids.
PIECE = 1 << 16
NODE = ("depth", "x1", "x2")
EMPTY = hashlib.sha256(b"").hexdigest()


def _name(text: Column, k: int) -> Column:
    """Sixty bits of a hash: the k-th fifteen hex digits."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1 + 15 * k, 15), 16, 10).cast("bigint")


def contents(rows: DataFrame) -> DataFrame:
    """conv_id, turn, a, b (hash of role and text), words."""
    rows = pick(rows, conv_id="bigint", turn="bigint", role="string", text="string").filter("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return rows.select("conv_id", "turn", _name(both, 0).alias("a"), _name(both, 1).alias("b"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, k from 1, a, b, words) of all turns and (conv_id, n) of all conversations; both stashed."""
    placed = scan(turns, ["conv_id", F.col("turn").asc_nulls_first(), "a", "b", "words"])
    convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("start"))
    out = stash(placed.join(convs, "conv_id").select("conv_id", (F.col("position") - F.col("start") + 1).alias("k"), "a", "b", "words"))
    lengths = stash(convs.select("conv_id", "n"))
    discard(placed)
    return out, lengths


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first one of their family: (conv_id, depth, a, b, words), (conv_id, n)."""
    own, lengths = numbered(turns)
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = lengths.select(F.col("conv_id").alias("family"), F.col("n").alias("there"))
    convs = lengths.select("conv_id", "n", borrowed.alias("h"), family.alias("family")).join(heads, "family", "left")
    convs = convs.withColumn("shared", F.least(F.coalesce("there", F.lit(0)), "h"))
    sizes = stash(convs.select("conv_id", "family", "h", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    rest = own.join(sizes.select("conv_id", "h", "shared"), "conv_id").filter("k > h").select("conv_id", (F.col("shared") + F.col("k") - F.col("h")).alias("depth"), "a", "b", "words")
    first = own.filter((F.col("k") < BORROWED) & (family == F.col("conv_id"))).withColumnRenamed("conv_id", "family")
    shared = sizes.select("conv_id", "family", "shared").join(first, "family").filter("k <= shared").select("conv_id", F.col("k").alias("depth"), "a", "b", "words")
    out = stash(rest.unionByName(shared))
    ends = sizes.select("conv_id", "n")
    ends._stash = sizes._stash
    discard(own, lengths)
    return out, ends


def named(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, the node of each of its turns, the node's parent (p1, p2), words, whether the conversation ends there."""
    at = F.concat_ws(":", "depth", "a", "b")
    placed = scan(rows.select("conv_id", "depth", "words", _name(at, 0).alias("x1"), _name(at, 1).alias("x2")), ["conv_id", "depth"], xors=["x1", "x2"])
    over = [F.col(f"{x}_upto").bitwiseXOR(F.col(x)).alias(f"{x}_over") for x in ("x1", "x2")]  # up to the turn before
    first = placed.filter("depth = 1").select("conv_id", *over).withColumnsRenamed({"x1_over": "s1", "x2_over": "s2"})
    joined = placed.join(first, "conv_id").join(lengths, "conv_id")
    node = [F.col(f"x{i}_upto").bitwiseXOR(F.col(f"s{i}")) for i in (1, 2)]
    out = stash(
        joined.select(
            "conv_id", "depth", node[0].alias("x1"), node[1].alias("x2"), node[0].bitwiseXOR(F.col("x1")).alias("p1"), node[1].bitwiseXOR(F.col("x2")).alias("p2"), "words", (F.col("depth") == F.col("n")).alias("ends")
        )
    )
    discard(placed)
    return out


def counted(rows: DataFrame) -> DataFrame:
    """The nodes but the root: name, parent, conv_id, n_convs, words, n_children."""
    nodes = stash(rows.groupBy(*NODE).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")))
    below = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    out = stash(nodes.join(below, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    discard(nodes)
    return out


def leaf_ranks(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, leaf) of the conversation that stands for each leaf, in lexicographic order."""
    leaves = nodes.filter("n_children = 0").select("conv_id")
    forks = stash(nodes.filter("n_children > 1").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2")))
    # all first turns are compared: the root is one name for all of them
    below = rows.filter("depth > 1").join(small(forks), ["depth", "p1", "p2"]).select("conv_id", *NODE)
    compared = below.unionByName(rows.filter("depth = 1").select("conv_id", *NODE)).join(leaves, "conv_id", "left_semi")
    paths = compared.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*NODE))).alias("path"))
    ranked = scan(paths, ["path"])
    out = stash(ranked.select("conv_id", F.col("position").alias("leaf")))
    discard(ranked, forks)
    return out


def preorder(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with position and subtree_end (the root is 0), n_leaves and saved_tokens."""
    ranks = leaf_ranks(rows, nodes)
    spans = rows.join(ranks, "conv_id").groupBy(*NODE).agg(F.min("leaf").alias("first"), F.max("leaf").alias("last"))
    own = nodes.join(spans, list(NODE)).withColumn("is_leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    placed = scan(own, ["first", "depth"], sums=["is_leaf", "saved"])
    ends = placed.filter("is_leaf = 1").select(F.col("first").alias("last"), F.col("position").alias("end"), F.col("is_leaf_upto").alias("leaves_end"), F.col("saved_upto").alias("saved_end"))
    out = stash(
        placed.join(ends, "last").select(
            *NODE, "p1", "p2", "conv_id", "n_convs", "n_children", (F.col("position") + 1).alias("position"), (F.col("end") + 1).alias("subtree_end"),
            (F.col("leaves_end") - F.col("is_leaf_upto") + F.col("is_leaf")).alias("n_leaves"), (F.col("saved_end") - F.col("saved_upto") + F.col("saved")).alias("saved_tokens"),
        )
    )
    discard(placed, ranks)
    return out


def id_hashes(ends: DataFrame) -> DataFrame:
    """The name of each node in ``ends`` (name, conv_id) and the SHA-256 of its ids in order, joined by commas."""
    names = list(NODE)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, first, ",".join(held))], names=[*names, "first", "ids"])

        for batch in batches:
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != key or size >= PIECE:
                    if held:
                        yield out()
                    key, first, held, size = node, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield out()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node == key:
                    digest.update(b",")
                else:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*names, "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, digest.hexdigest())], names=[*names, "ends_sha256"])

    kinds = "depth bigint, x1 bigint, x2 bigint"
    cut = ends.select(*names, "conv_id").repartitionByRange(*names, "conv_id").sortWithinPartitions(*names, "conv_id").mapInArrow(pieces, f"{kinds}, first bigint, ids string")
    return cut.repartition(*names).sortWithinPartitions(*names, "first").mapInArrow(hashes, f"{kinds}, ends_sha256 string")


def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of the conversations in ``lengths`` (conv_id, n), whose turns are ``rows`` (conv_id, depth, a, b, words)."""
    spark = rows.sparkSession
    n_convs, least = lengths.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    turns = named(rows, lengths)
    nodes = counted(turns)
    tree = preorder(turns, nodes)
    n_children, n_leaves, saved, last = tree.agg(F.count_if(F.col("depth") == 1), F.sum(F.when(F.col("depth") == 1, F.col("n_leaves"))), F.sum(F.when(F.col("depth") == 1, F.col("saved_tokens"))), F.max("position")).first()
    zero = F.lit(0).cast("bigint")
    ended = turns.filter("ends").select(*NODE, "conv_id").unionByName(lengths.filter("n = 0").select(*(zero.alias(c) for c in NODE), "conv_id"))
    parents = tree.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    top = {"conv_id": least, "n_convs": n_convs, "n_children": n_children, "position": 0, "subtree_end": last or 0, "n_leaves": n_leaves or 1, "saved_tokens": saved or 0, "parent_conv_id": None}
    root = spark.range(1 if n_convs else 0).select(*(zero.alias(c) for c in NODE), *(F.lit(v).cast("bigint").alias(c) for c, v in top.items()))
    deep = tree.filter("depth > 1").join(parents, ["depth", "p1", "p2"]).drop("p1", "p2")
    flat = tree.filter("depth = 1").drop("p1", "p2").withColumn("parent_conv_id", F.lit(least).cast("bigint"))
    out = root.unionByName(flat).unionByName(deep).join(id_hashes(ended), list(NODE), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "position", "subtree_end"
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are (conv_id, turn, role, text)."""
    own, lengths = numbered(contents(conversations))
    return trie(own.withColumnRenamed("k", "depth"), lengths)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(contents(table(spark, sf_dir, "conversations")))).drop("position", "subtree_end")


ORACLE = rf"""
WITH crc AS (SELECT {CRC_TABLE} AS t),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc_sql('x')} % {BORROWED} AS h FROM (SELECT conv_id, hex(encode(conv_id::VARCHAR)) AS x FROM (SELECT DISTINCT conv_id FROM o)), crc),
j AS (SELECT c.conv_id, 0 AS own, k, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % {FAMILY} AND k <= h UNION ALL SELECT conv_id, 1, k, role, text FROM c JOIN o USING (conv_id) WHERE k > h),
p AS (SELECT conv_id, row_number() OVER w AS d, text, list((role, text)) OVER w AS path FROM j WINDOW w AS (PARTITION BY conv_id ORDER BY own, k)),
m AS (SELECT conv_id, d, md5(to_json(path)::VARCHAR) AS node, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY node, d),
u AS (SELECT n.*, q.node AS parent FROM n LEFT JOIN m q ON q.conv_id = n.conv_id AND q.d = n.depth - 1),
f AS (SELECT u.*, coalesce(k.n, 0) AS n_children FROM u LEFT JOIN (SELECT parent, count(*) AS n FROM u WHERE parent IS NOT NULL GROUP BY parent) k ON k.parent = u.node),
s AS (SELECT m.node, count(*) FILTER (f.n_children = 0) AS n_leaves, CAST(sum((f.n_convs - 1) * f.words) AS BIGINT) AS saved_tokens FROM f JOIN m ON m.conv_id = f.conv_id AND m.d <= f.depth GROUP BY m.node),
e AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM m WHERE (conv_id, d) IN (SELECT (conv_id, max(d)) FROM m GROUP BY conv_id) GROUP BY node)
SELECT f.conv_id, CAST(depth AS BIGINT) AS depth, g.conv_id AS parent_conv_id, f.n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN s USING (node) LEFT JOIN e USING (node) LEFT JOIN (SELECT node AS parent, conv_id FROM f) g USING (parent)
"""
