"""Full-text search over segments: postings, prefix terms, phrases, relevance; over rows as they are, or over a
stored index that is replaced by recordings.

Tokens are runs of letters and digits, folded.  By default each word of a query is a prefix and all must
occur; a query in double quotes is an exact phrase.  A word with an inner hyphen or underscore is a
phrase whose last token is a prefix; other marks inside a word are dropped, which joins its pieces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from jatoba.functions import text as T
from jatoba.operators.snapshot import Snapshots, between

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Term:
    """Tokens that follow one another; the last is a prefix unless exact."""

    tokens: tuple[str, ...]
    exact: bool


def parse(query: str | None) -> list[Term]:
    """No terms for a query that can't match (fewer than two characters, or none that count)."""
    q = (query or "").strip()
    if len(q) < 2:
        return []
    split = lambda s: tuple(re.findall(r"[^\W_]+", T.fold_py(s)))
    if len(q) > 2 and q[0] == q[-1] == '"':
        tokens = split(q[1:-1].replace('"', ""))
        return [Term(tokens, True)] if tokens else []
    words = ("".join(c for c in w if c.isalnum() or c in "-_") for w in q.split())
    return [Term(t, False) for w in words if (t := split(w))]


def postings(segs: DataFrame) -> DataFrame:
    """(token, rec_id, seg_id, pos, len); segments without text are left out.  Write it sorted by token,
    so that a prefix prunes row groups."""
    said = segs.filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    found = F.regexp_extract_all(T.fold(F.col("text")), F.lit(TOKEN), F.lit(0))
    return said.select("rec_id", "seg_id", found.alias("t")).select("rec_id", "seg_id", F.size("t").alias("len"), F.posexplode("t").alias("pos", "token")).select("token", "rec_id", "seg_id", "pos", "len")


def _matches(index: DataFrame, term: Term, number: int) -> DataFrame:
    """Occurrences of one term: (rec_id, seg_id, len, term, pos)."""
    last = len(term.tokens) - 1
    out = None
    for k, token in enumerate(term.tokens):
        on = F.col("token").startswith(token) if k == last and not term.exact else F.col("token") == token
        rows = index.filter(on).select("rec_id", "seg_id", "len", (F.col("pos") - k).alias("pos"))
        out = rows if out is None else out.join(rows.select("rec_id", "seg_id", "pos"), ["rec_id", "seg_id", "pos"], "left_semi")
    return out.select("rec_id", "seg_id", "len", F.lit(number).alias("term"), "pos")


def relevance(tf, df, length, n, mean):
    """What one term adds to the score of a segment (BM25)."""
    idf = F.greatest(F.lit(1e-6), F.log((n - df + 0.5) / (df + 0.5)))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def search(segs: DataFrame, query: str, recordings: DataFrame | None = None, limit: int = 60, index: DataFrame | None = None) -> DataFrame:
    """(rec_id, seg_id, start_ms, falante, trecho, arquivo, created_at, score), best first.  The score is
    negative, the least is the best; equal scores go by start."""
    terms = parse(query)
    said = segs.filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    index = index if index is not None else postings(segs)
    if not terms:
        hits = said.limit(0).select("rec_id", "seg_id", F.lit(0.0).alias("score"))
    else:
        found = None
        for i, t in enumerate(terms):
            m = _matches(index, t, i)
            found = m if found is None else found.unionByName(m)
        tf = found.groupBy("rec_id", "seg_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        sizes = said.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(F.regexp_extract_all(T.fold(F.col("text")), F.lit(TOKEN), F.lit(0)))).alias("avg"))
        # one row of totals and one per term: their size does not depend on the data
        w = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(sizes))
        part = relevance(F.col("tf"), F.col("df"), F.col("len"), F.col("n"), F.col("avg"))
        hits = w.groupBy("rec_id", "seg_id").agg(F.sum(part).alias("s"), F.count(F.lit(1)).alias("k")).filter(F.col("k") == len(terms)).select("rec_id", "seg_id", (-F.round("s", 9)).alias("score"))
    out = hits.join(said.select("rec_id", "seg_id", "start_ms", "speaker", "text"), ["rec_id", "seg_id"])
    shown = snippet(F.col("text"), terms)
    out = out.select("rec_id", "seg_id", "start_ms", F.when(F.col("speaker") != "", F.col("speaker")).alias("falante"), shown.alias("trecho"), "score")
    if recordings is not None:
        out = out.join(recordings.select("rec_id", "filename", "created_at"), "rec_id", "left").withColumn("arquivo", F.coalesce("filename", F.lit("(removido)"))).drop("filename")
    return out.orderBy("score", "start_ms", "rec_id", "seg_id").limit(limit)


# ---- the stored index ------------------------------------------------------------------------------------

#: How the relations of an index are laid out.  Postings of a token that very many segments have fill several files.
ORDERS = {"segments": ("rec_id", "seg_id"), "postings": ("token", "rec_id", "seg_id"), "sizes": ("rec_id",)}
#: The largest number of hits that a search returns; so many rows reach the driver.
MOST = 200
#: Postings in the files of a search up to which one task ranks them, without a shuffle.
ONE_TASK = 4_000_000


def posting_lists(segs: DataFrame) -> DataFrame:
    """(token, rec_id, seg_id, start_ms, len, at array<int>): one row for each token of a segment."""
    said = segs.filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    found = F.regexp_extract_all(T.fold(F.col("text")), F.lit(TOKEN), F.lit(0))
    words = said.select("rec_id", "seg_id", "start_ms", found.alias("t"))
    each = words.select("rec_id", "seg_id", "start_ms", F.size("t").alias("len"), F.posexplode("t").alias("pos", "token"))
    return each.groupBy("token", "rec_id", "seg_id", "start_ms", "len").agg(F.sort_array(F.collect_list("pos")).alias("at"))


def index_sizes(segs: DataFrame) -> DataFrame:
    """(rec_id, n, len): segments and tokens of each recording."""
    n = F.size(F.regexp_extract_all(T.fold(F.col("text")), F.lit(TOKEN), F.lit(0)))
    return segs.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.sum(n).cast("bigint").alias("len"))


def index_store(spark: SparkSession, root: str, more: dict | None = None) -> Snapshots:
    return Snapshots(spark, root, {**ORDERS, **(more or {})})


def index_commit(store: Snapshots, segs: DataFrame | None, touched: DataFrame, more: dict | None = None) -> dict:
    """Replace the touched recordings in an index by ``segs``, or delete them; ``more`` relations change with them.  The
    version notes segments and tokens of the whole index, from what the touched recordings had and have."""

    def total(rows: DataFrame) -> tuple[int, int]:
        r = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("len"), F.lit(0))).first()
        return int(r[0]), int(r[1])

    def notes(old: dict, name: str) -> dict:
        had = total(store.read("sizes", old).join(touched.select("rec_id").distinct(), "rec_id", "left_semi")) if old["parts"].get("sizes") else (0, 0)
        have = total(store.written(name, "sizes")) if segs is not None else (0, 0)
        before = old["notes"].get("index", (0, 0))
        return {**old["notes"], "index": [b - h + n for b, h, n in zip(before, had, have, strict=True)]}

    changes: dict = {}
    if segs is not None:
        changes["segments"] = segs.filter(T.strip(F.coalesce("text", F.lit(""))) != "")
        changes["postings"] = lambda made: posting_lists(made("segments"))
        changes["sizes"] = lambda made: index_sizes(made("segments"))
    changes |= more or {}
    return store.commit(changes, touched, notes)


def _ranges(terms: list[Term]) -> list[tuple[str, str]]:
    """The tokens that may match, as ranges."""
    return sorted({(t, t + "\U0010ffff" if k == len(term.tokens) - 1 and not term.exact else t) for term in terms for k, t in enumerate(term.tokens)})


def _found(postings: DataFrame, term: Term, number: int) -> DataFrame:
    """(rec_id, seg_id, start_ms, len, term, tf) of one term over posting lists."""
    last = len(term.tokens) - 1
    out = None
    for k, token in enumerate(term.tokens):
        prefix = k == last and not term.exact
        rows = postings.filter(F.col("token").startswith(token) if prefix else F.col("token") == token)
        at = F.transform("at", lambda x: x - k)  # noqa: B023  called at once
        if out is None:
            out = rows.select("rec_id", "seg_id", "start_ms", "len", at.alias("at"))
        elif prefix:  # several tokens may begin so
            out = out.join(rows.groupBy("rec_id", "seg_id").agg(F.flatten(F.collect_list(at)).alias("b")), ["rec_id", "seg_id"])
        else:
            out = out.join(rows.select("rec_id", "seg_id", at.alias("b")), ["rec_id", "seg_id"])
        if k:
            out = out.withColumn("at", F.array_intersect("at", "b")).drop("b").filter(F.size("at") > 0)
    return out.groupBy("rec_id", "seg_id", "start_ms", "len").agg(F.sum(F.size("at")).alias("tf")).withColumn("term", F.lit(number))


def pruned(store: Snapshots, terms: list[Term], version: dict | None = None) -> DataFrame:
    """The postings that may matter: only files, and in them row groups, whose tokens reach into the terms' ranges."""
    ranges = _ranges(terms)
    return store.read("postings", version, ranges).filter(between(F.col("token"), ranges))


def search_index(store: Snapshots, query: str, limit: int = 60, recordings: str | None = None) -> DataFrame:
    """As ``search``, over a stored index: (rec_id, seg_id, start_ms, falante, trecho, [arquivo, created_at,] score).

    Totals come with the version, document frequencies are counted first (one row a term); then at most ``limit`` ranked
    hits reach the driver, and segments are read for those recordings only."""
    spark, version, terms = store.spark, store.version(), parse(query)
    limit = max(1, min(MOST, limit))
    top = []
    if terms and version["parts"].get("postings"):
        postings = pruned(store, terms, version)
        few = store.rows_within("postings", version, _ranges(terms)) <= ONE_TASK
        if few:
            postings = postings.coalesce(1)
        found = reduce(DataFrame.unionByName, [_found(postings, t, i) for i, t in enumerate(terms)])
        found = (found.coalesce(1) if few else found).persist()
        try:
            df = {r["term"]: r["count"] for r in found.groupBy("term").count().collect()}
            if len(df) == len(terms):
                n, size = version["notes"]["index"]
                counts = F.element_at(F.create_map(*[F.lit(x) for kv in df.items() for x in kv]), F.col("term"))
                part = relevance(F.col("tf"), counts, F.col("len"), F.lit(n), F.lit(size / n))
                scored = found.groupBy("rec_id", "seg_id", "start_ms").agg(F.sum(part).alias("s"), F.count(F.lit(1)).alias("k")).filter(F.col("k") == len(terms))
                top = scored.select("rec_id", "seg_id", "start_ms", (-F.round("s", 9)).alias("score")).orderBy("score", "start_ms", "rec_id", "seg_id").limit(limit).collect()
        finally:
            found.unpersist()
    hits = spark.createDataFrame(top, "rec_id bigint, seg_id bigint, start_ms bigint, score double")
    recs = sorted({r["rec_id"] for r in top})
    within = [(r, r) for r in recs]
    said = store.read("segments", version, within).filter(F.col("rec_id").isin(recs)).select("rec_id", "seg_id", "speaker", "text")
    out = said.join(F.broadcast(hits), ["rec_id", "seg_id"])
    names = ["rec_id", "seg_id", "start_ms", F.when(F.col("speaker") != "", F.col("speaker")).alias("falante"), snippet(F.col("text"), terms).alias("trecho")]
    if recordings is not None:
        named = store.read(recordings, version, within).filter(F.col("rec_id").isin(recs)).select("rec_id", "filename", "created_at")
        out = out.join(F.broadcast(named), "rec_id", "left")
        names += [F.coalesce("filename", F.lit("(removido)")).alias("arquivo"), "created_at"]
    return out.select(*names, "score").orderBy("score", "start_ms", "rec_id", "seg_id")


def search_like(segs: DataFrame, query: str, limit: int = 60, recordings: DataFrame | None = None) -> DataFrame:
    """Plain substring search, case and accents aside; quotes are ordinary characters.  With recordings, hits carry
    filename and created_at, null for those that are gone, and the newest recordings come first."""
    q = (query or "").strip()
    hit = F.lit(False) if len(q) < 2 else T.fold(F.col("text")).contains(T.fold_py(q))
    hits = segs.filter(hit).select("rec_id", "seg_id", "start_ms", "text")
    if recordings is None:
        return hits.orderBy("start_ms", "rec_id", "seg_id").limit(limit)
    named = hits.join(recordings.select("rec_id", "filename", "created_at"), "rec_id", "left")
    return named.orderBy(F.desc_nulls_last("created_at"), "start_ms", "rec_id", "seg_id").limit(limit)


def snippet(text, terms: list[Term], size: int = 14):
    """About ``size`` words around the first hit, hits between <mark> and </mark>."""
    if not terms:
        return F.substring(text, 1, 160)
    words = T.ws_words(text)
    src, dst = T._accents()
    loose = lambda w: "".join(f"[{c}{''.join(s for s, d in zip(src, dst, strict=True) if d == c)}]" for c in w)
    pattern = "(?iuU)(?<![\\p{L}\\p{N}])(" + "|".join(loose(w) + ("" if not t.exact else "(?![\\p{L}\\p{N}])") for t in terms for w in t.tokens) + ")"
    at = F.coalesce(F.array_min(F.filter(F.transform(words, lambda w, i: F.when(w.rlike(pattern), i)), lambda x: x.isNotNull())), F.lit(0))
    start = F.greatest(F.lit(1), at - size // 3 + 1)
    cut = F.array_join(F.slice(words, start, F.lit(size)), " ")
    cut = F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + size - 1 < F.size(words), "…").otherwise(""))
    return F.regexp_replace(cut, pattern + r"([\p{L}\p{N}]*)", "<mark>$1$2</mark>")
