"""Benchmark decontamination by template canonicalisation, in column expressions only.

Numbers, names and units become typed placeholders, so a question with other numbers or names keeps
its template.  Windows of ``WIDTH`` template tokens of the benchmark are hashed once; windows of every
whole document are probed against them in the same code-generated stage that makes them, and only
item windows per (document, item, diagonal) leave it.  A diagonal is a candidate if its windows are at
least ``SHARE`` of the item's informative windows, or ``ENOUGH`` of them; so are neighbouring diagonals
together, as an inserted word moves all that follows: neighbours are no further apart than the item has
windows.  Capitals say nothing in upper or title case, so the words in lower case are probed beside the
template, and as a slot may be filled by more words than before, so is the template with runs of one
placeholder made one token; each reading has windows of its own (``KINDS``).  For candidates alone the
tokens are laid side by side and the slots compared: each value of the item has to map to one value
of the document of the same type, or the match is a coincidence of form.

Tokens stay aligned with words in every reading: a word, or a run of words in one slot, is one token.  A window with fewer than
``LITERAL`` literal tokens says nothing and is dropped.

Edge cases: null and empty texts, and texts or items of fewer than ``WIDTH`` tokens, match nothing; a
very long text is probed whole; rows that repeat are judged each, alike; an empty benchmark leaves
every document clean; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import documents, pick, stash, table

WIDTH, LITERAL, SHARE, ENOUGH, CONSISTENT = 8, 5, 0.5, 16, 0.8
#: The most benchmark windows that are broadcast (about 200 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Not in any text that is spaced; in ASCII, so that strings stay as short, and as fast, as they were.
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
#: Fixed word lists.
NUMBER_WORDS = "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|hundred|thousand|million|billion"
UNITS = "km|kms|kilometers|kilometres|m|meters|metres|cm|mm|miles|mile|feet|ft|inches|inch|kg|kgs|kilograms|grams|g|mg|pounds|lbs|tons|liters|litres|l|ml|gallons|seconds|minutes|hours|days|weeks|months|years|dollars|euros|cents|percent|mph|kmh|degrees|watts|volts"


# Each pattern below is a pass over every text, so what can be replaced together is; a space that stays is no match.
_KEPT = r"\p{L}\p{N}.!?%$€£'"
_MARKS = "[.!?%$€£']"
#: By first letter: most words fail at once.
_WORDS = "|".join(f"{a}(?:{'|'.join(w[1:] for w in NUMBER_WORDS.split('|') if w[0] == a)})" for a in sorted({w[0] for w in NUMBER_WORDS.split("|")}))


def spaced(text: Column) -> Column:
    """One space before each word; units parted from numbers; marks other than sentence ends and %$€£' gone."""
    return F.concat(F.lit(" "), F.regexp_replace(text, rf"(\p{{N}})(?=\p{{L}})| [^{_KEPT}]+|[^{_KEPT} ][^{_KEPT}]*", "$1 "))


def _bare(t: Column) -> Column:
    """Without marks at the ends of tokens.  Patterns begin with what is rare, so most characters fail at once."""
    return F.regexp_replace(t, rf"{_MARKS}(?:(?<= .){_MARKS}*|{_MARKS}*(?= |$))", "")


def _cut(t: Column) -> Column:
    return F.array_remove(F.split(t, " "), "")


def _raw(s: Column) -> Column:
    return _bare(F.lower(s))


def _template(s: Column) -> Column:
    """A capital inside a sentence begins a name."""
    t = F.lower(F.regexp_replace(s, r"\p{Lu}(?<=[^.!? ] .)[\p{L}']*", NAME))
    t = F.regexp_replace(t, r"[$€£]?\p{N}[^ ]*", NUMBER)
    t = F.regexp_replace(t, rf" (?:{_WORDS})(?=[ .!?]|$)", " " + NUMBER)
    return _bare(F.regexp_replace(t, rf"{NUMBER} (?:{UNITS})(?=[ .!?]|$)", f"{NUMBER} {UNIT}"))


def raw_tokens(s: Column) -> Column:
    return _cut(_raw(s))


def template_tokens(s: Column) -> Column:
    return _cut(_template(s))


#: Readings of a text.
KINDS = ("template", "slots", "exact")


def _windows(df: DataFrame, h: str, kind: str, w: str) -> DataFrame:
    """Add ``w``: hashes of all windows of ``WIDTH`` tokens, whose hashes are ``h``, by doubling, in order, other ones for each kind."""
    assert WIDTH == 8
    df = df.withColumn("__1", F.col(h))
    for k in (1, 2, 4):
        n = F.greatest(F.size(f"__{k}") - k, F.lit(0))
        own = [F.lit(KINDS.index(kind))] if k == 4 else []
        joined = lambda a, b: F.xxhash64(a, b, *own)  # noqa: E731, B023  called at once
        df = df.withColumn(f"__{2 * k}", F.zip_with(F.slice(f"__{k}", F.lit(1), n), F.slice(f"__{k}", F.lit(k + 1), n), joined)).drop(f"__{k}")
    return df.withColumnRenamed("__8", w)


def _probes(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, pos, h) of all readings.  Tokens are hashed once for ``template`` and ``slots``, and only hashes go on: empty tokens are
    dropped as such.  Exploded as outer: for a plain explode the optimizer would push a test of its size down and make the tokens again."""
    hashed = lambda t: F.array_remove(F.transform(F.split(t, " "), lambda x: F.xxhash64(x)), F.xxhash64(F.lit("")))
    df = df.withColumn("__s", spaced(F.coalesce(F.col(text), F.lit("")))).withColumn("__template", hashed(_template(F.col("__s")))).withColumn("__exact", hashed(_raw(F.col("__s"))))
    slots = [F.xxhash64(F.lit(x)) for x in (NUMBER, NAME, UNIT)]
    df = df.withColumn("__slots", F.filter("__template", lambda x, i: (i == 0) | (F.get("__template", i - 1) != x) | ~x.isin(*slots)))
    for kind in KINDS:
        df = _windows(df, f"__{kind}", kind, f"__w_{kind}")
    each = df.select(*keep, F.explode_outer(F.array(*(f"__w_{kind}" for kind in KINDS))).alias("w"))
    return each.select(*keep, F.posexplode_outer("w").alias("pos", "h"))


def _is_slot(x: Column) -> Column:
    return x.isin(NUMBER, NAME, UNIT)


def _starts(c: Column) -> Column:
    """Where the tokens of the reading ``slots`` begin: a placeholder after its like goes on with the slot."""
    return F.filter(F.transform(c, lambda x, i: F.when(~_is_slot(x) | (i == 0) | (F.get(c, i - 1) != x), i)), lambda i: i.isNotNull())


def _collapsed(c: Column) -> Column:
    return F.filter(c, lambda x, i: ~_is_slot(x) | (i == 0) | (F.get(c, i - 1) != x))


def _read(df: DataFrame, text: str) -> DataFrame:
    """Add a column of tokens for each kind."""
    s = df.withColumn("__s", spaced(F.coalesce(F.col(text), F.lit(""))))
    s = s.withColumn("template", template_tokens(F.col("__s"))).withColumn("exact", raw_tokens(F.col("__s"))).drop("__s")
    return s.withColumn("slots", _collapsed(F.col("template")))


def _tokens(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, kind, c, r): tokens and words of each reading."""
    read = _read(df, text).withColumn("__from", _starts(F.col("template")))
    until = lambda i: F.coalesce(F.get("__from", i + 1), F.size("exact"))
    words = F.transform("__from", lambda x, i: F.array_join(F.slice("exact", x + 1, until(i) - x), " "))
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("c"), (words if kind == "slots" else F.col("exact")).alias("r")) for kind in KINDS))
    return read.select(*keep, F.inline(each))


def item_tokens(benchmark: DataFrame) -> DataFrame:
    """(item, kind, c, r)."""
    items = benchmark.filter("item_id is not null").groupBy(F.col("item_id").alias("item")).agg(F.min("text").alias("text"))
    return _tokens(items, "text", "item")


def item_windows(items: DataFrame) -> DataFrame:
    """(h, item, kind, at, n_windows): informative windows of the benchmark."""
    told = None
    for kind in KINDS:
        each = _windows(items.filter(F.col("kind") == kind).withColumn("__h", F.transform("c", lambda x: F.xxhash64(x))), "__h", kind, "w").select("item", "kind", "c", F.posexplode_outer("w").alias("at", "h"))
        literal = F.size(F.filter(F.slice("c", F.col("at") + 1, WIDTH), lambda x: ~_is_slot(x)))
        some = each.filter(F.col("h").isNotNull()).filter(literal >= LITERAL).select("item", "kind", "at", "h")
        told = some if told is None else told.unionAll(some)
    return told.withColumn("n_windows", F.count(F.lit(1)).over(W.partitionBy("item", "kind")))


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, row, item, kind, n_windows, windows, lines): one diagonal, or neighbours whose windows are enough
    together; ``lines`` has (windows, diagonal, at), the longest first.  ``row`` is a hash of the text, so that rows
    with one doc_id and other texts are kept apart; rows that repeat are counted once."""
    windows = item_windows(items)
    if windows.count() <= BROADCAST_ROWS:
        windows = F.broadcast(windows)
    probe = _probes(docs.select("doc_id", F.xxhash64("text").alias("row"), "text"), "text", "doc_id", "row")
    hit = probe.join(windows, "h").groupBy("doc_id", "row", "item", "kind", "n_windows", (F.col("pos") - F.col("at")).alias("diagonal"))
    line = hit.agg(F.collect_set("at").alias("at"))
    pair = ("doc_id", "row", "item", "kind", "n_windows")
    order = W.partitionBy(*pair).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.col("n_windows"), F.lit(True))
    near = line.withColumn("__new", apart.cast("int")).withColumn("__near", F.sum("__new").over(order))
    one = F.struct((-F.size("at")).alias("less"), "diagonal", F.array_sort("at").alias("at"))
    joined = near.groupBy(*pair, "__near").agg(F.sort_array(F.collect_list(one)).alias("lines"))
    enough = lambda windows: (windows >= SHARE * F.col("n_windows")) | (windows >= ENOUGH)
    whole = F.size(F.array_distinct(F.flatten(F.transform("lines", lambda x: x["at"]))))
    alone = F.transform(F.filter("lines", lambda x: enough(-x["less"])), lambda x: F.struct((-x["less"]).alias("windows"), F.array(x).alias("lines")))
    together = F.when((F.size("lines") > 1) & enough(whole), F.array(F.struct(whole.alias("windows"), F.col("lines")))).otherwise(F.array())
    return joined.select(*pair, F.inline(F.concat(alone, together)))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row, item, windows, n_windows, slots, broken): the best consistent candidate of each pair."""
    items = item_tokens(benchmark)
    found = stash(candidates(docs, items))
    exact = found.filter("kind = 'exact'").select("doc_id", "row", "item", "windows", "n_windows", F.lit(0).alias("slots"), F.lit(0).alias("broken"))
    found = found.filter("kind <> 'exact'")
    some = found.select(F.col("doc_id").alias("d"), F.col("row").alias("x")).distinct()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("row"), "text").join(some, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("x")), "left_semi").dropDuplicates(["doc_id", "row"])
    ours = _tokens(keyed, "text", "doc_id", "row").filter("kind <> 'exact'").select(F.col("doc_id").alias("d"), F.col("row").alias("x"), F.col("kind").alias("k"), F.col("c").alias("oc"), F.col("r").alias("o"))
    side = found.join(ours, found["doc_id"].eqNullSafe(ours["d"]) & (found["row"] == ours["x"]) & (found["kind"] == ours["k"])).join(items, ["item", "kind"])
    # a token of the item lies on the longest line that has a window over it; a single line is laid along the whole item
    over = lambda i: F.filter("lines", lambda x: (F.size("lines") == 1) | F.exists(x["at"], lambda a: (a <= i) & (i < a + WIDTH)))
    laid = F.transform("c", lambda k, i: F.when(_is_slot(k), F.struct(k.alias("kind"), F.get("r", i).alias("theirs"), (i + F.get(over(i), F.lit(0))["diagonal"]).alias("to"))))
    pairs = F.transform(laid, lambda x: F.when((x["to"] >= 0) & (F.get("oc", x["to"]) == x["kind"]), F.struct(x["kind"], x["theirs"], F.get("o", x["to"]).alias("ours"))))
    laid = side.withColumn("pairs", F.array_distinct(F.filter(pairs, lambda x: x.isNotNull())))
    values = F.size(F.array_distinct(F.transform("pairs", lambda x: F.struct(x["kind"].alias("k"), x["theirs"].alias("t")))))
    scored = laid.withColumn("slots", F.size("pairs")).withColumn("broken", F.size("pairs") - values)
    consistent = scored.filter(F.col("broken") <= (1 - CONSISTENT) * F.col("slots"))
    consistent = consistent.select(exact.columns).unionAll(exact)
    best = consistent.groupBy("doc_id", "row", "item").agg(F.max(F.struct("windows", "n_windows", "slots", "broken")).alias("b"))
    return best.select("doc_id", "row", "item", "b.*")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row, items, windows): documents that hold an item, with the items."""
    found = matches(docs, benchmark)
    return found.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("windows").alias("windows"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    bad = stash(contaminated(docs.select("doc_id", "text"), benchmark)).select(F.col("doc_id").alias("__d"), F.col("row").alias("__r"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__d"]) & (F.xxhash64(docs["text"]) == bad["__r"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    benchmark = pick(table(spark, sf_dir, "benchmark"), item_id="bigint", text="string")
    bad = contaminated(docs, benchmark)
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"))
    return rows.join(bad.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")) & (rows["row"] == bad["row"]), "left").select(
        "doc_id", F.col("d").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("windows", F.lit(0)).cast("bigint").alias("windows")
    )
