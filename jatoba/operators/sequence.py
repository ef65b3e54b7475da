"""Order-dependent operators over segments (rec_id, seg_id, speaker, start_ms, end_ms, text, words).

What a window can express is a window; all of these share one exchange on rec_id.  Folds whose state
is reset by their own decisions are an ``aggregate`` over an array of the words of a segment or the
segments of a recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from jatoba.functions import text as T

MAX_CHARS, MAX_LINES, MIN_CUE_MS, MAX_CUE_MS, SPLIT_GAP_MS, MAX_CPS = 42, 2, 1000, 6000, 600, 21.0
BUDGET = int(MAX_CHARS * MAX_LINES * 0.92)
PAUSE_MS, PARAGRAPH_SENTENCES, BLOCK_CHARS = 1200, 5, 900
SENTENCE_MS, SENTENCE_CHARS = 13_000, 210


def in_order():
    return W.partitionBy("rec_id").orderBy("seg_id")


def drop_hallucinations(raw: DataFrame) -> DataFrame:
    """Raw segments (text, no_speech_prob, avg_logprob) without invented phrases."""
    return raw.filter(~T.is_hallucination(F.col("text"), F.col("no_speech_prob"), F.col("avg_logprob")))


def drop_repeated(segs: DataFrame, most: int = 2) -> DataFrame:
    """Of a run of equal passages (case, accents and marks aside) the first ``most`` stay."""
    key = segs.withColumn("__k", T.sentence_key(F.col("text")))
    same = (F.col("__k") != "") & (F.col("__k") == F.lag("__k").over(in_order()))
    runs = key.withColumn("__same", F.coalesce(same, F.lit(False))).withColumn("__run", F.sum(F.when(F.col("__same"), 0).otherwise(1)).over(in_order()))
    ranked = runs.withColumn("__i", F.row_number().over(W.partitionBy("rec_id", "__run").orderBy("seg_id")))
    return ranked.filter(F.col("__i") <= most).drop("__k", "__same", "__run", "__i")


def renumber(segs: DataFrame) -> DataFrame:
    return segs.withColumn("seg_id", F.row_number().over(in_order()).cast("bigint"))


def turns(segs: DataFrame) -> DataFrame:
    """Consecutive segments of one speaker."""
    new = F.when(F.col("speaker").eqNullSafe(F.lag("speaker").over(in_order())) & (F.row_number().over(in_order()) > 1), 0).otherwise(1)
    marked = segs.withColumn("__new", new).withColumn("turn_id", F.sum("__new").over(in_order()))
    rows = F.sort_array(F.collect_list(F.struct("seg_id", "text")))
    return marked.groupBy("rec_id", "turn_id").agg(
        F.first("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "seg_id").alias("end_ms"), rows.alias("rows"),
    ).select("rec_id", F.col("turn_id").cast("bigint").alias("turn_id"), "speaker", "start_ms", "end_ms", F.array_join("rows.text", " ").alias("text"), F.col("rows.seg_id").alias("segments"))


def longest_pause(segs: DataFrame) -> DataFrame:
    gaps = segs.withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(in_order()))
    return gaps.groupBy("rec_id").agg(F.greatest(F.lit(0), F.coalesce(F.max("gap"), F.lit(0))).cast("bigint").alias("longest_pause_ms"))


def stretch_cues(cues: DataFrame, key: str = "seg_id") -> DataFrame:
    """Short cues last a second, but end 20 ms before the next; none is empty in time."""
    w = W.partitionBy("rec_id").orderBy(key)
    limit = F.coalesce(F.lead("start_ms").over(w), F.col("start_ms") + MIN_CUE_MS)
    short = F.col("end_ms") - F.col("start_ms") < MIN_CUE_MS
    end = F.when(short, F.least(F.col("start_ms") + MIN_CUE_MS, F.greatest(limit - 20, F.col("end_ms")))).otherwise(F.col("end_ms"))
    out = cues.withColumn("__end", end)
    return out.withColumn("end_ms", F.when(F.col("__end") <= F.col("start_ms"), F.col("start_ms") + 400).otherwise(F.col("__end"))).drop("__end")


def overlapping_cues(cues: DataFrame, key: str = "seg_id") -> DataFrame:
    """Cues that begin more than a millisecond before their predecessor ends."""
    w = W.partitionBy("rec_id").orderBy(key)
    return cues.withColumn("__e", F.lag("end_ms").over(w)).filter(F.col("start_ms") < F.col("__e") - 1).drop("__e")


def inherit_label(labels: DataFrame, label: str = "label") -> DataFrame:
    """A null label is that of the last labelled segment; 0 before any."""
    return labels.withColumn(label, F.coalesce(F.last(label, ignorenulls=True).over(in_order().rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))


def positions(rows: DataFrame, first: str, then: str, ranges: int = 64, into: str = "position") -> DataFrame:
    """Places from 1 in the order (first, then) over all rows, without gathering them: bounds from quantile sketches cut the
    rows into ranges, counts by range (a few thousand at most, to the driver) say where each range begins, and each numbers its
    own rows.  A value of ``first`` that fills whole ranges has ranges of its own, cut by ``then``.  Nulls come first."""
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx(first, cuts, 100 * ranges).alias("a"), F.percentile_approx(then, cuts, 100 * ranges).alias("b")).first()
    low, tie = bounds["a"] or [], bounds["b"] or []
    heavy = sorted({x for x in low if low.count(x) > 1})
    at_least = lambda col, values: sum((F.coalesce((F.col(col) >= F.lit(v)).cast("int"), F.lit(0)) for v in values), F.lit(0))
    own = F.coalesce(F.col(first).isin(heavy), F.lit(False)) if heavy else F.lit(False)
    # a heavy value is a bound, so in its range it comes before all others
    cut = rows.withColumn("__r", F.struct(at_least(first, sorted(set(low))).alias("a"), F.when(own, 0).otherwise(1).alias("o"), F.when(own, at_least(then, sorted(set(tie)))).otherwise(0).alias("b")))
    counts = sorted((tuple(r["__r"]), r["count"]) for r in cut.groupBy("__r").count().collect())
    starts, before = [], 0
    for key, n in counts:
        starts.append((key, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "__r struct<a:int,o:int,b:int>, __before bigint")
    within = F.row_number().over(W.partitionBy("__r").orderBy(first, then))
    return cut.withColumn("__i", within).join(F.broadcast(offsets), "__r").withColumn(into, F.col("__before") + F.col("__i")).drop("__r", "__i", "__before")


def queue_position(jobs: DataFrame) -> DataFrame:
    """Places of waiting jobs, first come first served."""
    return positions(jobs.filter("status = 'na_fila'"), "created_at", "job_id")


def speaker_rank(segs: DataFrame, label: str = "speaker") -> DataFrame:
    """Speakers numbered by talking time, equal ones by first appearance, with their share."""
    talk = segs.filter(F.col(label).isNotNull()).groupBy("rec_id", label).agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("talk_ms"), F.count(F.lit(1)).alias("segments"), F.min("seg_id").alias("first_seg"))
    w = W.partitionBy("rec_id")
    rank = F.row_number().over(w.orderBy(F.desc("talk_ms"), "first_seg"))
    return talk.withColumn("rank", rank).withColumn("name", F.concat(F.lit("Falante "), F.col("rank").cast("string"))).withColumn("percent", F.round(100.0 * F.col("talk_ms") / F.sum("talk_ms").over(w), 1))


# ---- folds: a state struct runs over an array and collects where pieces begin --------------------------


def _begin(rows: Column, state: dict[str, Column], step) -> Column:
    """Indexes at which a new piece begins.  ``step(state, row)`` gives (whether it begins here, the next state)."""
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"), *(c.alias(n) for n, c in state.items()))

    def go(s: Column, x: Column) -> Column:
        new, after = step(s, x)
        starts = F.when(new, F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"])
        return F.struct(starts.alias("starts"), (s["i"] + 1).alias("i"), *(after[n].alias(n) for n in state))

    return F.aggregate(rows, zero, go, lambda s: s["starts"])


def _pieces(rows: Column, starts: Column) -> Column:
    return F.transform(starts, lambda s, k: F.slice(rows, s + 1, F.coalesce(F.get(starts, k + 1), F.size(rows)) - s))


WORDS = "array<struct<word:string,start_ms:bigint,end_ms:bigint,probability:double>>"


def _sentence_step(s: Column, w: Column):
    """A piece is closed by a sentence end, or when it is long, at a soft mark or at any rate."""
    since = F.when(s["open"], s["since"]).otherwise(w["start_ms"])
    chars = F.when(s["open"], s["chars"]).otherwise(0) + F.length(w["word"])
    took = w["end_ms"] - since
    long = (took >= SENTENCE_MS) | (chars >= SENTENCE_CHARS)
    closed = w["ends"] | (long & (w["soft"] | (took >= SENTENCE_MS * 1.8)))
    return ~s["open"], {"open": ~closed, "since": since, "chars": chars}


def _cue_step(s: Column, w: Column):
    """A piece is full when the next word would pass its budget or time, or comes after a gap; a sentence end
    closes one that is half full."""
    n = F.length(w["token"])
    full = (s["chars"] + n + 1 > BUDGET) | (w["start_ms"] - s["last"] > SPLIT_GAP_MS) | (w["end_ms"] - s["since"] > MAX_CUE_MS)
    new = ~s["open"] | full
    chars = F.when(new, n).otherwise(s["chars"] + n + 1)
    return new, {"open": ~(w["ends"] & (chars >= BUDGET * 0.5)), "since": F.when(new, w["start_ms"]).otherwise(s["since"]), "chars": chars, "last": w["end_ms"]}


def _cut(segs: DataFrame, step, state: dict[str, Column], tokens: bool) -> DataFrame:
    """Rows (rec_id, seg_id, part, speaker, start_ms, end_ms, text, confidence, words); the words of one segment
    decide, so partitions do not matter.  A segment without words is one piece."""
    if "words" not in segs.columns:
        segs = segs.withColumn("words", F.lit(None).cast(WORDS))
    token = lambda w: T.strip(w["word"])
    told = F.transform("words", lambda w: F.struct(w["word"].alias("word"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), w["probability"].alias("probability"), token(w).alias("token"), T.ends_sentence(w["word"]).alias("ends"), token(w).rlike("[,;:—–]$").alias("soft")))
    rows = segs.select("rec_id", "seg_id", "speaker", "start_ms", "end_ms", "text", "confidence", (F.filter(told, lambda w: w["token"] != "") if tokens else told).alias("__w"), (F.size(F.coalesce("words", F.array().cast(WORDS))) > 0).alias("__has"))
    rows = rows.withColumn("__starts", _begin(F.col("__w"), state, step))
    said = lambda p: F.array_join(F.transform(p, lambda w: w["token"] if tokens else w["word"]), " ")

    def piece(p: Column, k: Column) -> Column:
        known = F.filter(F.transform(p, lambda w: w["probability"]), lambda x: x.isNotNull())
        mean = F.round(F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known), 3)
        words = F.transform(p, lambda w: F.struct(w["word"].alias("word"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), w["probability"].alias("probability")))
        return F.struct(k.cast("int").alias("part"), F.get(p, F.lit(0))["start_ms"].alias("start_ms"), F.element_at(p, -1)["end_ms"].alias("end_ms"), T.clean_text(said(p)).alias("text"), F.when(F.size(known) > 0, mean).otherwise(F.col("confidence")).alias("confidence"), words.alias("words"))

    cut = F.filter(F.transform(_pieces(F.col("__w"), F.col("__starts")), piece), lambda x: x["text"] != "")
    whole = F.array(F.struct(F.lit(0).alias("part"), "start_ms", "end_ms", "text", "confidence", F.array().cast(WORDS).alias("words")))
    # outer: for a plain explode the optimizer would make the pieces again to test their number
    each = rows.select("rec_id", "seg_id", "speaker", F.explode_outer(F.when(F.col("__has"), cut).otherwise(whole)).alias("p")).filter("p is not null")
    return each.select("rec_id", "seg_id", "p.part", "speaker", "p.start_ms", "p.end_ms", "p.text", "p.confidence", "p.words")


def _number(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy("rec_id").orderBy("seg_id", "part")).cast("bigint"))


def split_sentences(segs: DataFrame) -> DataFrame:
    """Segments with word times cut into sentences; numbered anew."""
    rows = _number(_cut(segs, _sentence_step, {"open": F.lit(False), "since": F.lit(None).cast("bigint"), "chars": F.lit(0)}, False), "__id")
    return rows.drop("seg_id", "part").withColumnRenamed("__id", "seg_id")


def build_cues(segs: DataFrame) -> DataFrame:
    """Subtitle blocks: packed by words, stretched, wrapped to balanced lines, with their reading speed."""
    none = F.lit(None).cast("bigint")
    packed = _number(_cut(segs, _cue_step, {"open": F.lit(False), "since": none, "chars": F.lit(0), "last": none}, True), "cue_id").drop("words", "confidence")
    cues = stretch_cues(packed, "cue_id").filter(T.strip(F.col("text")) != "")
    cues = cues.withColumn("cue_id", F.row_number().over(W.partitionBy("rec_id").orderBy("seg_id", "part")).cast("bigint"))
    text = T.strip(F.col("text"))
    return cues.select("rec_id", "cue_id", "speaker", "start_ms", "end_ms", text.alias("text"), T.wrap_balanced(text, MAX_CHARS, MAX_LINES).alias("lines"), F.round(T.chars_per_second(text, F.col("start_ms"), F.col("end_ms")), 1).alias("cps"))


def subtitle_report(cues: DataFrame, most: int = 50) -> DataFrame:
    """Blocks, and the first of those that are too fast, too long or overlap."""
    w = W.partitionBy("rec_id").orderBy("cue_id")
    speed = T.chars_per_second(F.col("text"), F.col("start_ms"), F.col("end_ms"))
    marked = cues.withColumn("__s", speed).withColumn("__o", F.coalesce(F.col("start_ms") < F.lag("end_ms").over(w) - 1, F.lit(False))).withColumn("__l", F.exists("lines", lambda x: F.length(x) > MAX_CHARS))
    ids = lambda on: F.slice(F.sort_array(F.collect_list(F.when(on, F.col("cue_id")))), 1, most)
    return marked.groupBy("rec_id").agg(F.count(F.lit(1)).alias("blocos"), ids(F.col("__s") > MAX_CPS).alias("acima_do_cps"), ids(F.col("__l")).alias("linhas_longas"), ids(F.col("__o")).alias("sobrepostas"), F.round(F.avg("__s"), 1).alias("cps_medio"))


# ---- folds over a recording: its segments, in order, are one array ------------------------------------


def _said(segs: DataFrame) -> DataFrame:
    """(rec_id, rows): segments that say something, with whether they end a sentence."""
    text = T.strip(F.coalesce("text", F.lit("")))
    rows = segs.select("rec_id", "seg_id", "speaker", "start_ms", "end_ms", text.alias("t")).filter("t <> ''")
    ends = T.ends_sentence(F.element_at(T.ws_words(F.col("t")), -1))
    return rows.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("seg_id", "speaker", "start_ms", "end_ms", "t", ends.alias("ends")))).alias("rows"))


def _readable(p: Column) -> Column:
    return T.capitalize_sentences(T.clean_text(F.array_join(F.transform(p, lambda x: x["t"]), " ")))


def paragraphs(segs: DataFrame) -> DataFrame:
    """Readable paragraphs: a new one for another speaker, or after a closed sentence and a pause or five sentences."""

    def step(s: Column, x: Column):
        other = F.coalesce(x["speaker"] != s["who"], F.lit(False))
        rest = s["ended"] & ((x["start_ms"] - s["last"] >= PAUSE_MS) | (s["sentences"] >= PARAGRAPH_SENTENCES))
        new = (s["i"] == 0) | other | rest
        return new, {"who": x["speaker"], "last": x["end_ms"], "ended": x["ends"], "sentences": F.when(new, 0).otherwise(s["sentences"]) + x["ends"].cast("int")}

    state = {"who": F.lit(None).cast("string"), "last": F.lit(None).cast("bigint"), "ended": F.lit(False), "sentences": F.lit(0)}
    cut = _said(segs).withColumn("starts", _begin(F.col("rows"), state, step))
    return cut.select("rec_id", F.posexplode(_pieces(F.col("rows"), F.col("starts"))).alias("pos", "p")).select("rec_id", "pos", _readable(F.col("p")).alias("texto"))


def dialogue(segs: DataFrame) -> DataFrame:
    """Blocks of one voice with short gaps and at most about 900 characters."""

    def step(s: Column, x: Column):
        joins = (s["i"] > 0) & x["speaker"].eqNullSafe(s["who"]) & (x["start_ms"] - s["last"] < 3 * PAUSE_MS) & (s["chars"] < BLOCK_CHARS)
        return ~joins, {"who": x["speaker"], "last": x["end_ms"], "chars": F.when(joins, s["chars"] + 1).otherwise(0) + F.length(x["t"])}

    state = {"who": F.lit(None).cast("string"), "last": F.lit(None).cast("bigint"), "chars": F.lit(0)}
    cut = _said(segs).withColumn("starts", _begin(F.col("rows"), state, step))
    block = cut.select("rec_id", F.posexplode(_pieces(F.col("rows"), F.col("starts"))).alias("pos", "p"))
    first, last = F.get("p", F.lit(0)), F.element_at("p", -1)
    return block.select("rec_id", "pos", first["speaker"].alias("speaker"), first["start_ms"].alias("start_ms"), last["end_ms"].alias("end_ms"), _readable(F.col("p")).alias("texto"))


def reading(segs: DataFrame) -> DataFrame:
    """(rec_id, pos, speaker, texto): the dialogue of recordings that have speakers, the paragraphs of the others."""
    voices = F.max(F.coalesce(F.col("speaker") != "", F.lit(False))).over(W.partitionBy("rec_id"))
    marked = segs.withColumn("__v", voices)
    told = dialogue(marked.filter("__v").drop("__v")).select("rec_id", "pos", "speaker", "texto")
    return told.unionByName(paragraphs(marked.filter("not __v").drop("__v")).select("rec_id", "pos", F.lit(None).cast("string").alias("speaker"), "texto"))
