"""The prefix trie against a plain one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from jatoba.llm import trie

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
FIELDS = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(convs):
    """convs: id -> list of (role, text).  Rows as the query's, with position and subtree_end by walking the tree."""
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    rows = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        saved = sum((len(nodes[q]) - 1) * len(WORDS.findall(q[-1][1])) for q in below if q)
        rows.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest(), len(below)))
    return rows


def plain_rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(family, [])[:h] + turns[h:]
    return out


def odd_conversations(seed):
    """Shared beginnings, copies, missing family heads, gaps, nulls, one long conversation, ids below zero."""
    r = random.Random(seed)
    vocab = [("user", "a b"), ("assistant", "a b"), ("user", ""), ("user", "c d e"), ("system", " x\ty ")]
    convs = {c: [r.choice(vocab) for _ in range(r.randint(1, 6))] for c in r.sample(range(-45, 130), 90)}
    for c in list(convs)[:12]:
        convs[c] = convs[list(convs)[0]][:5]
    convs[400] = [("user", "q")] * 300
    convs[401] = [("user", "q")] * 200 + [("user", "z")]
    rows = [(c, k * 2 if k else None, *t) for c, turns in convs.items() for k, t in enumerate(turns)]
    r.shuffle(rows)
    return rows + [(None, 1, "user", "lost")], convs


def tuples(df):
    return sorted(df.collect(), key=lambda r: (r["conv_id"], r["depth"]))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_a_plain_one(spark, tmp_path, seed):
    rows, convs = odd_conversations(seed)
    df = spark.createDataFrame([(*r, "n") for r in rows], FIELDS + ", N_CONVS string").repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = trie.query(spark, str(tmp_path))
    assert got.dtypes == [(c, "string" if c == "ends_sha256" else "bigint") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    want = plain_trie(plain_rebuilt(convs))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(w[:8]) for w in want)


def test_preorder_intervals(spark):
    rows, convs = odd_conversations(3)
    df = spark.createDataFrame(rows, FIELDS)
    got = trie.prefix_trie(df).collect()
    want = plain_trie(convs)
    assert sorted((*tuple(r)[:8], r["subtree_end"] - r["position"] + 1) for r in got if r["depth"]) == sorted(w for w in want if w[1])
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    at = {r["position"]: r for r in got}
    for r in got:  # whatever stands inside an interval ends inside it, and the next row is the first child
        inside = [at[k] for k in range(r["position"] + 1, r["subtree_end"] + 1)]
        assert all(x["subtree_end"] <= r["subtree_end"] and x["depth"] > r["depth"] for x in inside)
        assert sum(x["depth"] == r["depth"] + 1 for x in inside) == r["n_children"]


def test_ids_are_hashed_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 16)
    rows = [(c, 1, "user", "same" if c % 3 else "other") for c in range(-30, 400)]
    got = trie.prefix_trie(spark.createDataFrame(rows, FIELDS).repartition(6))
    want = plain_trie({c: [("user", t)] for c, _, _, t in rows})
    assert sorted(r["ends_sha256"] for r in got.collect()) == sorted(w[7] for w in want)


def test_nulls_repeats_and_nothing(spark):
    empty = spark.createDataFrame([], FIELDS)
    assert trie.prefix_trie(empty).count() == 0
    rows = [(1, 1, None, None), (2, 1, "", ""), (3, 1, "user", "a"), (3, 1, "user", "a"), (4, None, "user", "a"), (4, 1, "user", "a")]
    got = {(r["conv_id"], r["depth"]): r["n_convs"] for r in trie.prefix_trie(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == {(1, 0): 4, (1, 1): 2, (3, 1): 2, (3, 2): 2}
    one = spark.createDataFrame([(21, 0, "user", "a")], FIELDS)  # its only turn is dropped when it borrows from nobody
    h = zlib.crc32(b"21") % 4
    left = trie.trie(*trie.rebuilt(trie.contents(one))).collect()
    assert [r["n_leaves"] for r in left] == [1] * (1 if h else 2)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = con.execute(trie.ORACLE).fetchall()
    assert sorted(map(str, (tuple(r) for r in trie.query(spark, "/root/testdata/sf0.01").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))) == sorted(map(str, want))
