"""Text mining over units (rec_id, seg_id, text, ...): all relational, but for the ranks of a recording's graph.

A unit is a sentence or segment; terms are content words.  Weights: idf = ln(1 + N / df), tf = 1 + ln c,
vectors of unit length.  N counts all units of a recording, also those without terms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from jatoba.functions import text as T

LOW_CONFIDENCE, SUMMARY, KEYWORDS, CHAPTER_MS = 0.55, 7, 14, 90_000
#: Commitments said aloud (pattern, weight): fixed values.
COMMITMENTS = (
    (r"\bfic(ou|amos|o)\s+de\b", 3.0),
    (r"\b(vou|vamos|irei|iremos)\s+\w+(ar|er|ir)\b", 2.5),
    (r"\b(precis|necessit)(a|o|amos|am)\b", 2.0),
    (r"\b(tem|temos|tenho|terá|teremos)\s+que\b", 2.0),
    (r"\b(envi|mand|manda|marc|agend|confirm|verific|revis|prepar|valid)\w*\b", 1.5),
    (r"\b(prazo|deadline|entrega|até\s+(segunda|terça|quarta|quinta|sexta|sábado|domingo|amanhã|hoje|dia\s+\d+))\b", 2.5),
    (r"\b(pendente|pendência|responsáve(l|is)|encarregad)\w*\b", 2.0),
    (r"\b(fazer|criar|abrir|fechar|resolver|corrigir|ajustar)\b", 1.0),
)


def _dealt(units: DataFrame, group: str) -> DataFrame:
    """``units`` by group over all shuffle partitions.  Small shuffles of texts are put together by their bytes, but each word
    becomes rows in the task that reads them, so the number is given."""
    return units.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), group)


def term_counts(units: DataFrame, group: str = "rec_id", unit: str = "seg_id") -> DataFrame:
    """(group, unit, term, c)."""
    return units.select(group, unit, F.explode(T.tokens(F.col("text"))).alias("term")).groupBy(group, unit, "term").agg(F.count(F.lit(1)).alias("c"))


def vectors(units: DataFrame, group: str = "rec_id", unit: str = "seg_id") -> DataFrame:
    """(group, unit, n, term, c, df, idf, weight): each term of each unit, and one row with a null term for a unit without any.
    Counts of units and document frequencies are windows inside a group, so texts are read, cut and shuffled once."""
    n = F.count(F.lit(1)).over(W.partitionBy(group))
    each = _dealt(units.select(group, unit, "text"), group).select(group, unit, n.alias("n"), T.tokens(F.col("text")).alias("__t")).select(group, unit, "n", F.explode_outer("__t").alias("term"))
    tf = each.groupBy(group, unit, "n", "term").agg(F.count(F.lit(1)).alias("c"))
    df = tf.withColumn("df", F.count(F.lit(1)).over(W.partitionBy(group, "term"))).withColumn("idf", F.log(1 + F.col("n") / F.col("df")))
    w = df.withColumn("__w", F.when(F.col("term").isNotNull(), (1 + F.log("c")) * F.col("idf")))
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(W.partitionBy(group, unit)))
    return w.withColumn("weight", F.col("__w") / F.when(norm == 0, 1.0).otherwise(norm)).drop("__w")


def document_frequency(units: DataFrame, group: str = "rec_id") -> DataFrame:
    """(group, term, df, n, idf)."""
    n = F.count(F.lit(1)).over(W.partitionBy(group))
    each = _dealt(units.select(group, "text"), group).select(group, n.alias("n"), F.array_distinct(T.tokens(F.col("text"))).alias("__t")).select(group, "n", F.explode("__t").alias("term"))
    return each.groupBy(group, "term", "n").agg(F.count(F.lit(1)).alias("df")).select(group, "term", "df", "n", F.log(1 + F.col("n") / F.col("df")).alias("idf"))


def tfidf(units: DataFrame, group: str = "rec_id", unit: str = "seg_id") -> DataFrame:
    """(group, unit, term, weight), normalised."""
    return vectors(units, group, unit).filter("term is not null").select(group, unit, "term", "weight")


def cosine_adjacent(units: DataFrame, group: str = "rec_id", unit: str = "seg_id") -> DataFrame:
    """(group, unit, similarity) of each unit with the next one; units are numbered without gaps."""
    w = W.partitionBy(group, "term").orderBy(unit)
    follows = F.lead(unit).over(w) == F.col(unit) + 1
    v = vectors(units, group, unit).withColumn("__d", F.when(F.col("term").isNotNull() & follows, F.col("weight") * F.lead("weight").over(w)).otherwise(0.0))
    dots = v.groupBy(group, unit).agg(F.sum("__d").alias("similarity"))
    return dots.withColumn("__last", F.max(unit).over(W.partitionBy(group))).filter(F.col(unit) < F.col("__last")).select(group, unit, "similarity")


def keywords(units: DataFrame, top: int = KEYWORDS, group: str = "rec_id", unit: str = "seg_id") -> DataFrame:
    """(group, pos, termo, ocorrencias, peso): terms by (1 + ln c) idf, and pairs that occur almost always
    together in place of their parts."""
    n = F.count(F.lit(1)).over(W.partitionBy(group))
    said = _dealt(units.select(group, unit, "text"), group).select(group, unit, n.alias("n"), T.content_pairs(F.col("text")).alias("__p"))
    said = said.select(group, unit, "n", F.posexplode("__p").alias("at", "p"), F.col("__p"))
    after = F.get("__p", F.col("at") + 1)
    # a word stands for itself, and with the one after it for a pair
    one = F.struct(F.col("p.term").alias("left"), F.lit("").alias("right"), F.col("p.raw").alias("raw"))
    two = F.struct(F.col("p.term").alias("left"), after["term"].alias("right"), F.concat("p.raw", F.lit(" "), after["raw"]).alias("raw"))
    each = said.select(group, unit, "n", "at", F.explode(F.when(after.isNotNull(), F.array(one, two)).otherwise(F.array(one))).alias("k"))
    counts = each.groupBy(group, "n", F.col("k.left").alias("left"), F.col("k.right").alias("right")).agg(F.count(F.lit(1)).alias("c"), F.count_distinct(unit).alias("df"), F.min(F.struct(unit, "at", "k.raw")).alias("f"))
    counts = counts.filter((F.col("right") == "") | (F.col("c") >= 3)).withColumn("idf", F.log(1 + F.col("n") / F.col("df")))
    single = F.col("right") == ""
    # pairs stand with their left word, then with their right one; all inside a group
    by_left, by_right = W.partitionBy(group, "left"), W.partitionBy(group, F.when(single, F.col("left")).otherwise(F.col("right")))
    for side, w in (("l", by_left), ("r", by_right)):
        counts = counts.withColumn(f"__c{side}", F.max(F.when(single, F.col("c"))).over(w)).withColumn(f"__i{side}", F.max(F.when(single, F.col("idf"))).over(w))
    kept = ~single & (F.col("c") >= 0.6 * F.least("__cl", "__cr"))
    marked = counts.withColumn("__kept", kept)
    gone = F.coalesce(F.max("__kept").over(by_left), F.lit(False)) | F.coalesce(F.max("__kept").over(by_right), F.lit(False))
    scored = marked.withColumn("__gone", gone).filter(F.when(single, ~F.col("__gone")).otherwise(F.col("__kept")))
    weight = lambda i: (1 + F.log("c")) * i
    scored = scored.select(group, F.when(single, weight(F.col("idf"))).otherwise(weight(F.col("__il") + F.col("__ir")) * 0.75).alias("w"), "c", "f", F.when(single, F.col("f.raw")).otherwise(T.title_case(F.col("f.raw"))).alias("termo"), F.when(single, 0).otherwise(1).alias("kind"))
    # weights to ten places, so that equal ones are equal however they were summed
    order = W.partitionBy(group).orderBy(F.round("w", 10).desc(), "kind", f"f.{unit}", "f.at")
    ranked = scored.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= top)
    peak = F.max("w").over(W.partitionBy(group))
    return ranked.select(group, "pos", "termo", F.col("c").alias("ocorrencias"), F.round(F.col("w") / peak, 3).alias("peso"))


def action_items(units: DataFrame, most: int = 12) -> DataFrame:
    """(rec_id, seg_id, speaker, start_ms, texto, peso): sentences that sound like a commitment."""
    score = sum((F.when(F.col("text").rlike("(?iuU)" + p), w).otherwise(0.0) for p, w in COMMITMENTS), F.lit(0.0))
    found = units.filter(T.word_count(F.col("text")) >= 4).withColumn("peso", score).filter("peso >= 3.0")
    ranked = found.withColumn("__r", F.row_number().over(W.partitionBy("rec_id").orderBy(F.desc("peso"), "seg_id"))).filter(F.col("__r") <= most)
    return ranked.select("rec_id", "seg_id", "speaker", "start_ms", T.strip(F.col("text")).alias("texto"), F.round("peso", 1).alias("peso"))


def questions(units: DataFrame, most: int = 15) -> DataFrame:
    asked = units.withColumn("texto", T.strip(F.col("text"))).filter(F.col("texto").endswith("?") & (T.word_count(F.col("text")) >= 3))
    return asked.withColumn("__r", F.row_number().over(W.partitionBy("rec_id").orderBy("seg_id"))).filter(F.col("__r") <= most).select("rec_id", "seg_id", "speaker", "start_ms", "texto")


_EDGE = r"^[.,;:!?…\"'()]+|[.,;:!?…\"'()]+$"


def statistics(units: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Eleven figures per recording; ``durations`` (rec_id, duration_ms), else the last end."""
    w = W.partitionBy("rec_id").orderBy("seg_id")
    rows = units.withColumn("__pause", F.col("start_ms") - F.lag("end_ms").over(w))
    speech = F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")))
    base = rows.groupBy("rec_id").agg(
        F.sum(T.word_count(F.col("text"))).alias("palavras"), F.count(F.lit(1)).alias("frases"), speech.alias("speech"), F.greatest(F.lit(0), F.coalesce(F.max("__pause"), F.lit(0))).alias("pause"),
        F.sum(T.filler_count(F.col("text"))).alias("vicios_de_linguagem"), F.count_if(F.coalesce("confidence", F.lit(1.0)) < LOW_CONFIDENCE).alias("trechos_baixa_confianca"), F.max("end_ms").alias("last"),
    )
    words = units.select("rec_id", F.explode(T.ws_words(F.col("text"))).alias("w")).withColumn("w", F.regexp_replace("w", _EDGE, "")).filter("w <> ''")
    unique = words.groupBy("rec_id").agg(F.countDistinct(T.fold(F.col("w"))).alias("vocabulario_unico"))
    out = base.join(unique, "rec_id", "left")
    out = out.join(durations.select("rec_id", "duration_ms"), "rec_id", "left") if durations is not None else out.withColumn("duration_ms", F.col("last"))
    d, n = F.coalesce("duration_ms", F.lit(0)), F.coalesce("vocabulario_unico", F.lit(0))
    return out.select(
        "rec_id", "palavras", "frases", n.alias("vocabulario_unico"), F.when(F.col("palavras") > 0, F.round(n / F.col("palavras"), 3)).otherwise(0.0).alias("riqueza_lexical"),
        F.when(F.col("speech") > 6000, F.bround(F.col("palavras") / (F.col("speech") / 60000.0))).otherwise(0.0).cast("bigint").alias("palavras_por_minuto"),
        F.round(F.col("speech") / 1000.0, 1).alias("tempo_fala_s"), F.round(F.greatest(F.lit(0), d - F.col("speech")) / 1000.0, 1).alias("tempo_silencio_s"),
        F.when(d > 0, F.round(F.col("speech") / d, 3)).otherwise(0.0).alias("proporcao_fala"), F.round(F.col("pause") / 1000.0, 1).alias("maior_pausa_s"), "vicios_de_linguagem", "trechos_baixa_confianca",
    )


def speaker_statistics(units: DataFrame, terms: int | None = None) -> DataFrame:
    """Per speaker of recordings with two or more: segments, words, seconds, words a minute, and with
    ``terms`` the speaker's own keywords; most talkative first."""
    named = units.filter(F.coalesce("speaker", F.lit("")) != "")
    per = named.groupBy("rec_id", "speaker").agg(F.count(F.lit(1)).alias("trechos"), F.sum(T.word_count(F.col("text"))).alias("palavras"), F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("ms"), F.min("seg_id").alias("first"))
    per = per.withColumn("voices", F.count(F.lit(1)).over(W.partitionBy("rec_id"))).filter("voices >= 2").withColumn("tempo_s", F.round(F.col("ms") / 1000.0, 1))
    pos = F.row_number().over(W.partitionBy("rec_id").orderBy(F.desc("tempo_s"), "first"))
    out = per.select("rec_id", pos.alias("pos"), F.col("speaker").alias("nome"), "trechos", "palavras", "tempo_s", F.when(F.col("ms") > 6000, F.bround(F.col("palavras") / (F.col("ms") / 60000.0))).otherwise(0.0).cast("bigint").alias("palavras_por_minuto"))
    if terms is None:
        return out
    own = keywords(named.withColumn("__g", F.concat_ws("\0", F.col("rec_id").cast("string"), "speaker")), terms, "__g")
    listed = own.groupBy("__g").agg(F.sort_array(F.collect_list(F.struct("pos", "termo"))).alias("t")).select("__g", F.col("t.termo").alias("termos"))
    return out.join(listed, F.concat_ws("\0", F.col("rec_id").cast("string"), "nome") == F.col("__g"), "left").drop("__g").withColumn("termos", F.coalesce("termos", F.array().cast("array<string>")))


def history_summary(recs: DataFrame) -> DataFrame:
    """One row over finished recordings."""
    a = recs.filter("status = 'concluido'").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("d"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("w"), F.coalesce(F.sum("elapsed_s"), F.lit(0)).alias("e"), F.coalesce(F.avg("avg_confidence"), F.lit(0.0)).alias("c"))
    return a.select(F.col("n").alias("total"), F.round(F.col("d") / 3_600_000.0, 2).alias("horas"), F.col("w").alias("palavras"), F.when(F.col("e") > 1, F.round(F.col("d") / 1000.0 / F.col("e"), 2)).otherwise(0.0).alias("velocidade"), F.round("c", 3).alias("confianca"))


# ---- graph rank, summary and chapters ---------------------------------------------------------------


def sentence_graph(units: DataFrame) -> DataFrame:
    """(rec_id, i, j, w), i < j: sentences that share terms which at most 35 % of all (two at least) have."""
    usable = units.select("rec_id", "seg_id", "text")
    v = tfidf(usable)
    df = document_frequency(usable).select("rec_id", "term", "df", "n").filter(F.col("df") <= F.greatest(F.lit(2), F.floor(0.35 * F.col("n"))))
    v = v.join(df.select("rec_id", "term"), ["rec_id", "term"])
    right = v.select("rec_id", "term", F.col("seg_id").alias("j"), F.col("weight").alias("w2"))
    return v.join(right, ["rec_id", "term"]).filter("seg_id < j").groupBy("rec_id", F.col("seg_id").alias("i"), "j").agg(F.sum(F.col("weight") * F.col("w2")).alias("w"))


class _Vectors:
    """The vectors of one recording as numbers: per entry the unit, the term and the weight (20 bytes)."""

    def __init__(self, unit: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int):
        order = np.argsort(unit, kind="stable")
        self.unit, self.weight, self.n = unit[order], weight[order], n
        self.terms, self.term = np.unique(term[order], return_inverse=True)
        self.starts = np.searchsorted(self.unit, np.arange(n + 1))

    def ranks(self, damping: float = 0.85, rounds: int = 32) -> np.ndarray:
        """Ranks in the graph of units that share terms which at most 35 % of all (two at least) have.  Its edges are never
        made: a round sums what units hold by term and deals it out again, less what a unit would give itself.  Units
        without a neighbour pass nothing on, and what they hold is not dealt out again."""
        n = self.n
        if n <= 1:
            return np.ones(n)
        df = np.bincount(self.term, minlength=len(self.terms))
        on = ((df >= 2) & (df <= max(2, int(n * 0.35))))[self.term]  # a term of one unit is no edge
        u, t, w = self.unit[on], self.term[on], self.weight[on]
        own = np.bincount(u, w * w, n)

        def spread(x: np.ndarray) -> np.ndarray:
            return np.bincount(u, w * np.bincount(t, w * x[u], len(self.terms))[t], n) - own * x

        total = np.where(np.bincount(u, minlength=n) > 0, spread(np.ones(n)), 0.0)
        share = np.divide(1.0, total, out=np.zeros(n), where=total > 0)
        r = np.full(n, 1.0 / n)
        for _ in range(rounds):
            r = (1 - damping) / n + damping * spread(r * share)
        return r

    def choose(self, score: np.ndarray, most: int, alike: float = 0.55) -> list[int]:
        """The best scored units, each unlike all chosen before it; at equal scores the later one.  Ends with the last chosen."""
        chosen: list[int] = []
        sums = np.zeros((most, len(self.terms)))
        for k in np.lexsort((np.arange(self.n), score))[::-1]:
            part = slice(self.starts[k], self.starts[k + 1])
            t, w = self.term[part], self.weight[part]
            if not chosen or (sums[: len(chosen), t] @ w).max(initial=0.0) <= alike:
                sums[len(chosen), t] = w
                chosen.append(int(k))
                if len(chosen) == most:
                    break
        return sorted(chosen)


def _entries(units: DataFrame) -> DataFrame:
    """(rec_id, seg_id, term as a hash, weight); a unit without terms has one row, with nulls."""
    return vectors(units).select("rec_id", "seg_id", F.when(F.col("term").isNotNull(), F.xxhash64("term")).alias("term"), "weight")


def _read(pdf: pd.DataFrame) -> tuple[np.ndarray, _Vectors]:
    ids, unit = np.unique(pdf["seg_id"].to_numpy(), return_inverse=True)
    on = pdf["term"].notna().to_numpy()
    return ids, _Vectors(unit[on], pdf["term"].to_numpy()[on].astype(np.int64), pdf["weight"].to_numpy()[on], len(ids))


def textrank(units: DataFrame) -> DataFrame:
    """(rec_id, seg_id, rank): a recording's vectors are one group of numbers, a few megabytes for an hour of talk."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v = _read(pdf)
        return pd.DataFrame({"rec_id": pdf["rec_id"].iloc[0], "seg_id": ids, "rank": v.ranks()})

    return _entries(units).groupBy("rec_id").applyInPandas(run, "rec_id bigint, seg_id bigint, rank double")


def summarize(units: DataFrame, most: int = SUMMARY) -> DataFrame:
    """(rec_id, seg_id, text): the best ranked sentences that differ from one another, in order.  Only numbers go to the
    choice; the texts of those chosen are joined to it."""
    usable = units.filter(T.word_count(F.col("text")) >= 5).select("rec_id", "seg_id", "text")
    entries = _entries(usable)
    lengths = usable.select("rec_id", "seg_id", T.word_count(F.col("text")).alias("words"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, v = _read(left)
        if len(ids) > most:
            words = right.sort_values("seg_id")["words"].to_numpy()
            score = np.round(v.ranks() * np.minimum(1.0, words / 14.0) * np.where(words > 45, 0.7, 1.0), 12)
            ids = ids[v.choose(score, most)]
        return pd.DataFrame({"rec_id": key[0], "seg_id": ids})

    chosen = entries.groupBy("rec_id").cogroup(lengths.groupBy("rec_id")).applyInPandas(run, "rec_id bigint, seg_id bigint")
    return usable.join(chosen, ["rec_id", "seg_id"])


def topic_blocks(units: DataFrame) -> DataFrame:
    """Sentences of recordings with twelve or more, with their block of n // 60 + 3 sentences."""
    w = W.partitionBy("rec_id")
    rows = units.filter("text is not null and text <> ''").withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__i", F.row_number().over(w.orderBy("seg_id")) - 1)
    size = F.floor(F.col("__n") / 60) + 3
    return rows.filter("__n >= 12").withColumn("block", F.floor(F.col("__i") / size).cast("bigint")).drop("__n", "__i")


def topic_similarity(units: DataFrame) -> DataFrame:
    """(rec_id, block, similarity) of each block with the next, in recordings of three blocks or more."""
    rows = topic_blocks(units)
    texts = rows.groupBy("rec_id", "block").agg(F.sort_array(F.collect_list(F.struct("seg_id", "text"))).alias("r")).select("rec_id", "block", F.array_join("r.text", " ").alias("text"))
    enough = texts.withColumn("__b", F.count(F.lit(1)).over(W.partitionBy("rec_id"))).filter("__b >= 3").drop("__b")
    return cosine_adjacent(enough, "rec_id", "block")


def chapters(units: DataFrame, least_ms: int = CHAPTER_MS) -> DataFrame:
    """(rec_id, id, start_ms, end_ms, titulo, palavras, frases, abertura): where the vocabulary turns."""
    sims = topic_similarity(units)
    w = W.partitionBy("rec_id")
    order = w.orderBy("block")
    s = F.col("similarity")
    low = sims.withColumn("cut", F.avg("similarity").over(w) - 0.45 * F.stddev_pop("similarity").over(w)).withColumn("before", F.lag("similarity", 1, 1.0).over(order)).withColumn("after", F.lead("similarity", 1, 1.0).over(order)).filter((s <= F.col("cut")) & (s <= F.col("before")) & (s <= F.col("after")))
    rows = topic_blocks(units)
    starts = rows.groupBy("rec_id", "block").agg(F.min_by("start_ms", "seg_id").alias("start"))
    cand = low.select("rec_id", (F.col("block") + 1).alias("block")).join(starts, ["rec_id", "block"])
    first = starts.filter("block = 0").select("rec_id", F.col("start").alias("zero"))
    listed = cand.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("block", "start"))).alias("c")).join(first, "rec_id")
    # a boundary counts if it is far enough from the last one that counted
    kept = F.aggregate("c", F.struct(F.col("zero").alias("at"), F.array(F.lit(0).cast("bigint")).alias("b")), lambda a, x: F.when(x["start"] - a["at"] >= least_ms, F.struct(x["start"].alias("at"), F.concat(a["b"], F.array(x["block"])).alias("b"))).otherwise(a), lambda a: a["b"])
    marks = listed.select("rec_id", kept.alias("b")).filter(F.size("b") >= 2)
    placed = rows.join(marks, "rec_id").withColumn("id", F.size(F.filter("b", lambda x: x <= F.col("block")))).drop("b", "block")
    spans = placed.groupBy("rec_id", "id").agg(F.min_by("start_ms", "seg_id").alias("start_ms"), F.max_by("end_ms", "seg_id").alias("end_ms"), F.count(F.lit(1)).alias("frases"), F.substring(F.min_by("text", "seg_id"), 1, 160).alias("abertura"))
    terms = keywords(placed.withColumn("__g", F.concat_ws("/", F.col("rec_id").cast("string"), F.col("id").cast("string"))), 4, "__g")
    words = terms.groupBy("__g").agg(F.sort_array(F.collect_list(F.struct("pos", "termo"))).alias("t")).select("__g", F.col("t.termo").alias("palavras"))
    out = spans.join(words, F.concat_ws("/", F.col("rec_id").cast("string"), F.col("id").cast("string")) == F.col("__g"), "left")
    palavras = F.coalesce("palavras", F.array().cast("array<string>"))
    joined = F.array_join(F.slice(palavras, 1, 3), " · ")
    title = F.when(joined == "", "Trecho").when(joined.contains(" · "), joined).otherwise(T.title_case(joined))
    return out.select("rec_id", "id", "start_ms", "end_ms", title.alias("titulo"), palavras.alias("palavras"), "frases", "abertura")


def analyze(units: DataFrame) -> dict[str, DataFrame]:
    """All blocks of the analysis, by name."""
    said = units.filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    return {"resumo": summarize(said), "palavras_chave": keywords(said), "capitulos": chapters(said), "pendencias": action_items(said), "perguntas": questions(said), "estatisticas": statistics(said), "por_falante": speaker_statistics(said, 5)}
