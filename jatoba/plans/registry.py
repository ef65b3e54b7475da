"""Queries over the driver tables and their SQL, by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from jatoba.functions import labels as L, text as T
from jatoba.operators import analytics as A, export as X, search as S, sequence as Q, speakers as V, store as R, view
from jatoba.operators.snapshot import Snapshots, scratch
from jatoba.sources import adapters, media
from jatoba.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SEG = "WITH " + adapters.SEGMENTS_DUCKDB.strip()
_FOLD = "strip_accents(lower({}))"
_WORDS = r"len(list_filter(string_split_regex({}, '\s+'), lambda x: x <> ''))"
_STOP = ",".join(f"'{w}'" for w in sorted(T.STOPWORDS))
#: Content words of a text column in DuckDB.
_TOKENS = r"list_filter(regexp_extract_all(strip_accents(lower({})), '[0-9a-zà-öø-ÿ]{{2,}}'), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN (" + _STOP + "))"
#: Term statistics of segments: tf (rec_id, seg_id, term, c), df (rec_id, term, df, n, idf), v (…, weight).
_TFIDF = (
    f"tok AS (SELECT rec_id, seg_id, unnest({_TOKENS.format('text')}) AS term FROM units), tf AS (SELECT rec_id, seg_id, term, count(*) AS c FROM tok GROUP BY ALL),"
    "nn AS (SELECT rec_id, count(*) AS n FROM units GROUP BY rec_id), df AS (SELECT rec_id, term, count(*) AS df, ln(1 + any_value(n) / count(*)) AS idf, any_value(n) AS n FROM tf JOIN nn USING (rec_id) GROUP BY rec_id, term),"
    "w AS (SELECT rec_id, seg_id, term, (1 + ln(c)) * idf AS w FROM tf JOIN df USING (rec_id, term)),"
    "v AS (SELECT rec_id, seg_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY rec_id, seg_id)) AS weight FROM w)"
)


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def segs(spark, d, words=False):
    return adapters.segments(spark, d, words)


# ---- statistics -------------------------------------------------------------------------------------

query("speaker_statistics", _SEG + f""", p AS (SELECT rec_id, speaker, count(*) AS trechos, sum({_WORDS.format('text')}) AS palavras, sum(greatest(0, end_ms - start_ms)) AS ms, min(seg_id) AS f FROM segments GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY rec_id) AS voices, round(ms / 1000.0, 1) AS tempo_s FROM p)
SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY tempo_s DESC, f) AS pos, speaker AS nome, trechos, palavras, tempo_s,
CAST(CASE WHEN ms > 6000 THEN round_even(palavras / (ms / 60000.0), 0) ELSE 0 END AS BIGINT) AS palavras_por_minuto FROM k WHERE voices >= 2""")(lambda s, d: A.speaker_statistics(segs(s, d)))

_EDGE = "regexp_replace(x, '^[.,;:!?…\"''()]+|[.,;:!?…\"''()]+$', '', 'g')"
_MARKS = " + ".join(f"(length(t) - length(replace(t, '{T.fold_py(m)}', ''))) // {len(m)}" for m in T.FILLER_MARKS)
query("speech_statistics", _SEG + rf""", g AS (SELECT *, {_WORDS.format('text')} AS nw, {_FOLD.format('text')} AS t, start_ms - lag(end_ms) OVER (PARTITION BY rec_id ORDER BY seg_id) AS pause FROM segments),
u AS (SELECT rec_id, count(DISTINCT strip_accents(lower(y))) AS uniq FROM (SELECT rec_id, {_EDGE} AS y FROM (SELECT rec_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda q: q <> '')) AS x FROM segments)) WHERE y <> '' GROUP BY rec_id),
b AS (SELECT rec_id, sum(nw) AS palavras, count(*) AS frases, sum(greatest(0, end_ms - start_ms)) AS speech, greatest(0, coalesce(max(pause), 0)) AS pause, sum({_MARKS}) AS vicios_de_linguagem, count(*) FILTER (confidence < 0.55) AS trechos_baixa_confianca, max(end_ms) AS d FROM g GROUP BY rec_id)
SELECT rec_id, palavras, frases, uniq AS vocabulario_unico, round(uniq / palavras, 3) AS riqueza_lexical, CAST(CASE WHEN speech > 6000 THEN round_even(palavras / (speech / 60000.0), 0) ELSE 0 END AS BIGINT) AS palavras_por_minuto,
round(speech / 1000.0, 1) AS tempo_fala_s, round(greatest(0, d - speech) / 1000.0, 1) AS tempo_silencio_s, CASE WHEN d > 0 THEN round(speech / d, 3) ELSE 0 END AS proporcao_fala, round(pause / 1000.0, 1) AS maior_pausa_s, vicios_de_linguagem, trechos_baixa_confianca FROM b JOIN u USING (rec_id)""")(lambda s, d: A.statistics(segs(s, d)))

_REC = f""", recs AS (SELECT rec_id, max(end_ms) AS duration_ms, sum({_WORDS.format('text')}) AS word_count, count(*) AS segment_count, count(DISTINCT speaker) AS speakers, avg(confidence) FILTER (confidence > 0) AS avg_confidence,
'gravacao_' || rec_id || '.wav' AS filename, CASE WHEN rec_id % 7 = 3 THEN 'erro' ELSE 'concluido' END AS status, 1700000000 + rec_id * 3600 AS created_at, rec_id % 50 + 1 AS elapsed_s FROM segments GROUP BY rec_id)"""
query("recording_totals", _SEG + _REC + " SELECT rec_id, duration_ms, word_count, segment_count, speakers, round(avg_confidence, 6) AS avg_confidence FROM recs")(
    lambda s, d: adapters.recordings(segs(s, d)).select("rec_id", "duration_ms", "word_count", "segment_count", "speakers", F.round("avg_confidence", 6).alias("avg_confidence")))
query("history_summary", _SEG + _REC + " SELECT count(*) AS total, round(sum(duration_ms) / 3600000.0, 2) AS horas, sum(word_count) AS palavras, round(sum(duration_ms) / 1000.0 / sum(elapsed_s), 2) AS velocidade, round(avg(avg_confidence), 3) AS confianca FROM recs WHERE status = 'concluido'")(
    lambda s, d: A.history_summary(adapters.recordings(segs(s, d))))
query("orders_summary", "SELECT count(*) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total, round(coalesce(avg(o_totalprice), 0), 4) AS mean FROM orders WHERE o_orderstatus = 'F'")(
    lambda s, d: adapters.table(s, d, "orders").filter("o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"), F.round(F.coalesce(F.avg("o_totalprice"), F.lit(0.0)), 4).alias("mean")))
_PAYLOAD = "CASE WHEN rec_id % 5 = 2 THEN '{{\"status\": \"' || status || '\"' WHEN rec_id % 5 = 4 THEN '[]' ELSE '{{\"filename\": \"' || filename || '\", \"status\": \"' || status || '\", \"segments\": ' || segment_count || ', \"extra\": [1, 2]}}' END".replace("{{", "{").replace("}}", "}")
query("history_payload", _SEG + _REC + f", p AS (SELECT rec_id, created_at, {_PAYLOAD} AS payload FROM recs), k AS (SELECT *, CASE WHEN NOT json_valid(payload) THEN NULL WHEN json_type(payload) = 'OBJECT' THEN payload END AS j FROM p) SELECT rec_id, created_at, j ->> '$.filename' AS filename, j ->> '$.status' AS status, CAST(j ->> '$.segments' AS BIGINT) AS segments FROM k WHERE j IS NOT NULL")(
    lambda s, d: R.payloads(adapters.recordings(segs(s, d)).select("rec_id", "created_at", F.expr(_PAYLOAD).alias("payload"))).select("rec_id", "created_at", F.expr("try_variant_get(payload, '$.filename', 'string')").alias("filename"), F.expr("try_variant_get(payload, '$.status', 'string')").alias("status"), F.expr("try_variant_get(payload, '$.segments', 'bigint')").alias("segments")))
query("history_unreadable", _SEG + _REC + f", p AS (SELECT {_PAYLOAD} AS payload FROM recs) SELECT count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS dropped FROM (SELECT CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END AS ok FROM p)")(
    lambda s, d: R.payload_counts(adapters.recordings(segs(s, d)).select("rec_id", F.expr(_PAYLOAD).alias("payload"))))
query("low_confidence", _SEG + " SELECT rec_id, seg_id, confidence FROM segments WHERE confidence < 0.55")(lambda s, d: segs(s, d).filter(F.col("confidence") < A.LOW_CONFIDENCE).select("rec_id", "seg_id", "confidence"))
query("history_page", _SEG + _REC + " SELECT rec_id, filename, created_at FROM recs ORDER BY created_at DESC, rec_id LIMIT 50")(lambda s, d: R.history(adapters.recordings(segs(s, d)), 50).select("rec_id", "filename", "created_at"))

# ---- scalars ----------------------------------------------------------------------------------------

query("segment_slim", _SEG + " SELECT rec_id, seg_id, speaker, start_ms, end_ms, text, confidence FROM segments")(lambda s, d: R.slim(segs(s, d, True)))
_TS = "lpad((start_ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0')"
_CS = "CAST(round_even(start_ms / 10, 0) AS BIGINT)"
query("timestamps", _SEG + f""" SELECT rec_id, seg_id, {_TS} || ',' || lpad((start_ms % 1000)::VARCHAR, 3, '0') AS srt, {_TS} || '.' || lpad((start_ms % 1000)::VARCHAR, 3, '0') AS vtt, {_TS} AS short,
({_CS} // 360000)::VARCHAR || ':' || lpad(({_CS} // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({_CS} // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad(({_CS} % 100)::VARCHAR, 2, '0') AS ass FROM segments""")(
    lambda s, d: segs(s, d).select("rec_id", "seg_id", T.timestamp(F.col("start_ms")).alias("srt"), T.timestamp(F.col("start_ms"), ".").alias("vtt"), T.short_time(F.col("start_ms")).alias("short"), T.ass_time(F.col("start_ms")).alias("ass")))
query("duration_label", _SEG + _REC + """ SELECT rec_id, CASE WHEN duration_ms * 40 // 3600000 > 0 THEN (duration_ms * 40 // 3600000) || 'h ' || lpad((duration_ms * 40 // 60000 % 60)::VARCHAR, 2, '0') || 'min' ELSE (duration_ms * 40 // 60000) || 'min ' || lpad((duration_ms * 40 // 1000 % 60)::VARCHAR, 2, '0') || 's' END AS label FROM recs""")(
    lambda s, d: adapters.recordings(segs(s, d)).select("rec_id", T.duration_label(F.col("duration_ms") * 40 / 1000).alias("label")))
query("fold_text", f"SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents")(lambda s, d: adapters.table(s, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded")))
query("safe_name", r"""SELECT p_partkey, left(regexp_replace(regexp_replace(trim(regexp_replace(strip_accents(p_name || ' (é) #' || p_type), '[^0-9A-Za-z_\s.-]', '', 'g')), '\s+', '_', 'g'), '_+', '_', 'g'), 80) AS name FROM part""")(
    lambda s, d: adapters.table(s, d, "part").select("p_partkey", T.safe_name(F.concat("p_name", F.lit(" (é) #"), "p_type")).alias("name")))
_HURT = "replace(replace(replace(text, ', ', ' ,'), '. ', '.'), ' the ', '  the  ')"
query("clean_text")(lambda s, d: adapters.table(s, d, "documents").select("doc_id", T.clean_text(F.expr(_HURT)).alias("cleaned")))
#: Words of the whole texts, with a semicolon amid blanks after each: of the cleaning rules, those of spacing apply.
_SPACED = r"regexp_replace(regexp_replace(lower(text), '[^a-z \n]', '', 'g'), '[ \n]+', '  ;  ', 'g')"
query("clean_spacing", rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(trim(t), '\s+;', ';', 'g'), '[ \t]{{2,}}', ' ', 'g')) AS cleaned FROM (SELECT doc_id, {_SPACED} AS t FROM documents)""")(
    lambda s, d: adapters.table(s, d, "documents").select("doc_id", T.clean_text(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z \n]", ""), "[ \n]+", "  ;  ")).alias("cleaned")))
query("sentence_ends", _SEG + r""", k AS (SELECT rec_id, seg_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM segments) SELECT w, count(*) AS n FROM k
WHERE CASE WHEN ends_with(w, '.') THEN NOT regexp_full_match(w, '\d+\.') AND NOT coalesce(strip_accents(lower(nullif(regexp_extract(w, '(?:^|[\s(\["''])([\p{L}\p{N}_]{1,5})\.$', 1), ''))) IN (""" + ",".join(f"'{a}'" for a in T.ABBREVIATIONS) + r""") OR length(nullif(regexp_extract(w, '(?:^|[\s(\["''])([\p{L}\p{N}_]{1,5})\.$', 1), '')) = 1, false) ELSE regexp_matches(w, '[!?…]$') END GROUP BY w""")(
    lambda s, d: segs(s, d).select(F.explode(T.ws_words(F.col("text"))).alias("w")).filter(T.ends_sentence(F.col("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
query("capitalized")(lambda s, d: segs(s, d).select("rec_id", "seg_id", T.capitalize_sentences(F.lower("text")).alias("text")))
query("fillers_stripped")(lambda s, d: segs(s, d).select("rec_id", "seg_id", T.strip_fillers(F.col("text")).alias("text")))
query("vocabulary_applied")(lambda s, d: segs(s, d).select("rec_id", "seg_id", T.apply_vocabulary(F.col("text"), ("CONTRATO", "Relatório", "Você")).alias("text")))
query("filler_counts", _SEG + f" SELECT rec_id, seg_id, {_MARKS} AS n FROM (SELECT *, {_FOLD.format('text')} AS t FROM segments)")(lambda s, d: segs(s, d).select("rec_id", "seg_id", T.filler_count(F.col("text")).alias("n")))
query("hallucination_filter", _SEG + r""" SELECT rec_id, seg_id FROM (SELECT *, CASE WHEN seg_id % 4 = 0 THEN 'Obrigado por assistir!' WHEN seg_id % 4 = 1 THEN 'sim sim sim sim sim, não' ELSE text END AS t FROM segments) WHERE seg_id % 4 NOT IN (0, 1)""")(
    lambda s, d: Q.drop_hallucinations(segs(s, d).withColumn("text", F.when(F.col("seg_id") % 4 == 0, "Obrigado por assistir!").when(F.col("seg_id") % 4 == 1, "sim sim sim sim sim, não").otherwise(F.col("text"))).withColumn("no_speech_prob", F.lit(0.1)).withColumn("avg_logprob", F.lit(-0.2))).select("rec_id", "seg_id"))
query("raw_confidence", "SELECT l_orderkey, l_linenumber, round(least(1.0, exp(-l_discount * 10)), 3) AS confidence FROM lineitem")(
    lambda s, d: adapters.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.confidence(-F.col("l_discount") * 10).alias("confidence")))
query("escaped_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")(lambda s, d: adapters.table(s, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped")))

# ---- sequences ----------------------------------------------------------------------------------------

_DUP = ", dup AS (SELECT rec_id, (seg_id - 1) * 4 + k AS seg_id, CASE WHEN (rec_id + seg_id) % 2 = 0 THEN upper(text) || '!' ELSE text END AS text FROM segments, range(1, 5) r(k))"


def _dup(s, d):
    x = segs(s, d).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4))))
    return x.select("rec_id", ((F.col("seg_id") - 1) * 4 + F.col("k")).alias("seg_id"), F.when((F.col("rec_id") + F.col("seg_id")) % 2 == 0, F.concat(F.upper("text"), F.lit("!"))).otherwise(F.col("text")).alias("text"))


query("drop_repeated", _SEG + _DUP + r""", k AS (SELECT *, trim(strip_accents(lower(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g')))) AS key FROM dup),
i AS (SELECT *, sum(CASE WHEN key <> '' AND key = pk THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY seg_id) AS run FROM (SELECT *, lag(key) OVER (PARTITION BY rec_id ORDER BY seg_id) AS pk FROM k))
SELECT rec_id, seg_id FROM i QUALIFY row_number() OVER (PARTITION BY rec_id, run ORDER BY seg_id) <= 2""")(lambda s, d: Q.drop_repeated(_dup(s, d)).select("rec_id", "seg_id"))
_VOICE = "CASE WHEN speaker = 'system' THEN NULL WHEN seg_id % 5 < 2 THEN 'a' ELSE speaker END"


def _voiced(s, d):
    return segs(s, d).withColumn("speaker", F.when(F.col("speaker") == "system", F.lit(None)).when(F.col("seg_id") % 5 < 2, "a").otherwise(F.col("speaker")))


query("turns", _SEG + f""", t AS (SELECT * REPLACE ({_VOICE} AS speaker) FROM segments), i AS (SELECT *, sum(n) OVER (PARTITION BY rec_id ORDER BY seg_id) AS turn_id FROM (SELECT *, CASE WHEN row_number() OVER w > 1 AND speaker IS NOT DISTINCT FROM lag(speaker) OVER w THEN 0 ELSE 1 END AS n FROM t WINDOW w AS (PARTITION BY rec_id ORDER BY seg_id)))
SELECT rec_id, CAST(turn_id AS BIGINT) AS turn_id, any_value(speaker) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, seg_id) AS end_ms, string_agg(text, ' ' ORDER BY seg_id) AS text FROM i GROUP BY rec_id, turn_id""")(lambda s, d: Q.turns(_voiced(s, d)).drop("segments"))
query("longest_pause", _SEG + " SELECT rec_id, greatest(0, coalesce(max(g), 0)) AS longest_pause_ms FROM (SELECT rec_id, start_ms - lag(end_ms) OVER (PARTITION BY rec_id ORDER BY seg_id) AS g FROM segments) GROUP BY rec_id")(lambda s, d: Q.longest_pause(segs(s, d)))
_SHORT = ", sh AS (SELECT rec_id, seg_id, start_ms // 7 AS start_ms, (start_ms + (end_ms - start_ms) * (seg_id % 3)) // 7 AS end_ms FROM segments)"


def _short(s, d):
    return segs(s, d).select("rec_id", "seg_id", F.floor(F.col("start_ms") / 7).alias("start_ms"), F.floor((F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * (F.col("seg_id") % 3)) / 7).alias("end_ms"))


query("cue_stretch", _SEG + _SHORT + """ SELECT rec_id, seg_id, start_ms, CASE WHEN e <= start_ms THEN start_ms + 400 ELSE e END AS end_ms FROM (SELECT rec_id, seg_id, start_ms, CASE WHEN end_ms - start_ms < 1000 THEN least(start_ms + 1000, greatest(coalesce(lead(start_ms) OVER (PARTITION BY rec_id ORDER BY seg_id), start_ms + 1000) - 20, end_ms)) ELSE end_ms END AS e FROM sh)""")(lambda s, d: Q.stretch_cues(_short(s, d)))
query("cue_overlap", _SEG + _SHORT + " SELECT rec_id, seg_id FROM (SELECT *, lag(end_ms) OVER (PARTITION BY rec_id ORDER BY seg_id) AS e FROM sh) WHERE start_ms < e - 1")(lambda s, d: Q.overlapping_cues(_short(s, d)).select("rec_id", "seg_id"))
query("label_inherit", _SEG + " SELECT rec_id, seg_id, coalesce(last_value(CASE WHEN seg_id % 3 = 2 THEN rec_id % 4 END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY seg_id ROWS UNBOUNDED PRECEDING), 0) AS label FROM segments")(
    lambda s, d: Q.inherit_label(segs(s, d).select("rec_id", "seg_id", F.when(F.col("seg_id") % 3 == 2, F.col("rec_id") % 4).alias("label"))))
query("queue_position", "SELECT o_orderkey AS job_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders WHERE o_orderstatus = 'P'")(
    lambda s, d: Q.queue_position(adapters.table(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "P", "na_fila").otherwise("x").alias("status"))).select("job_id", "position"))
query("speaker_rank", _SEG + """ SELECT rec_id, speaker, talk_ms, segments, row_number() OVER (PARTITION BY rec_id ORDER BY talk_ms DESC, f) AS rank, round(100.0 * talk_ms / sum(talk_ms) OVER (PARTITION BY rec_id), 1) AS percent FROM (SELECT rec_id, speaker, sum(end_ms - start_ms) AS talk_ms, count(*) AS segments, min(seg_id) AS f FROM segments GROUP BY ALL)""")(
    lambda s, d: Q.speaker_rank(segs(s, d)).select("rec_id", "speaker", "talk_ms", "segments", "rank", "percent"))
query("renumbered", _SEG + " SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY seg_id) AS seg_id, text FROM segments WHERE seg_id % 2 = 0")(lambda s, d: Q.renumber(segs(s, d).filter("seg_id % 2 = 0")).select("rec_id", "seg_id", "text"))
query("segment_at", _SEG + " SELECT rec_id, min(seg_id) AS seg_id FROM segments WHERE start_ms <= 20000 AND end_ms >= 20000 GROUP BY rec_id")(lambda s, d: R.segment_at(segs(s, d), 20000))
query("sentence_split")(lambda s, d: Q.split_sentences(segs(s, d, True)).drop("words"))
query("cues")(lambda s, d: Q.build_cues(segs(s, d, True)))
query("subtitle_report")(lambda s, d: Q.subtitle_report(Q.build_cues(segs(s, d, True))))
query("paragraphs")(lambda s, d: Q.paragraphs(segs(s, d)))
query("dialogue")(lambda s, d: Q.dialogue(segs(s, d)))
query("wrap_balanced", _SEG + r""", c AS (SELECT rec_id, seg_id, text AS raw FROM segments), t AS (SELECT rec_id, seg_id, trim(raw) AS t, list_filter(string_split_regex(trim(raw), '\s+'), lambda x: x <> '') AS w FROM c),
k AS (SELECT *, unnest(range(1, greatest(2, len(w)))) AS i FROM t WHERE length(t) > 42 AND len(w) >= 2), h AS (SELECT *, length(array_to_string(w[1:i], ' ')) AS head FROM k),
b AS (SELECT rec_id, seg_id, arg_min(i, (abs(head - length(t) / 2) + CASE WHEN head > 42 OR length(t) - head - 1 > 42 THEN 168.0 WHEN regexp_matches(w[i], '[,;:—–.!?…]$') THEN -10.5 ELSE 0 END, i)) AS i FROM h GROUP BY ALL)
SELECT rec_id, seg_id, CASE WHEN i IS NULL THEN t ELSE array_to_string(w[1:i], ' ') || chr(10) || array_to_string(w[i + 1:], ' ') END AS lines FROM t LEFT JOIN b USING (rec_id, seg_id)""")(
    lambda s, d: segs(s, d).select("rec_id", "seg_id", F.array_join(T.wrap_two(F.col("text"), 42), "\n").alias("lines")))

# ---- text mining ----------------------------------------------------------------------------------------

_UNITS = _SEG + ", units AS (SELECT rec_id, seg_id, speaker, start_ms, end_ms, text FROM segments), "
query("token_counts", f"SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL")(lambda s, d: A.term_counts(adapters.table(s, d, "documents").withColumn("u", F.lit(0)), "doc_id", "u").select("doc_id", "term", "c"))
query("doc_frequency", _UNITS + _TFIDF + " SELECT rec_id, term, df, n, round(idf, 6) AS idf FROM df")(lambda s, d: A.document_frequency(segs(s, d)).select("rec_id", "term", "df", "n", F.round("idf", 6).alias("idf")))
query("tfidf_vectors", _UNITS + _TFIDF + " SELECT rec_id, seg_id, term, round(weight, 6) AS weight FROM v")(lambda s, d: A.tfidf(segs(s, d)).select("rec_id", "seg_id", "term", F.round("weight", 6).alias("weight")))
query("cosine_adjacent", _UNITS + _TFIDF + """, dots AS (SELECT a.rec_id, a.seg_id, sum(a.weight * b.weight) AS s FROM v a JOIN v b ON a.rec_id = b.rec_id AND a.term = b.term AND b.seg_id = a.seg_id + 1 GROUP BY ALL),
nx AS (SELECT rec_id, seg_id, lead(seg_id) OVER (PARTITION BY rec_id ORDER BY seg_id) AS nx FROM units) SELECT rec_id, seg_id, round(coalesce(s, 0), 6) AS similarity FROM nx LEFT JOIN dots USING (rec_id, seg_id) WHERE nx.nx IS NOT NULL""")(
    lambda s, d: A.cosine_adjacent(segs(s, d)).select("rec_id", "seg_id", F.round("similarity", 6).alias("similarity")))
query("sentence_graph", _UNITS + _TFIDF + """, ok AS (SELECT v.* FROM v JOIN df USING (rec_id, term) WHERE df <= greatest(2, floor(0.35 * n))) SELECT a.rec_id, a.seg_id AS i, b.seg_id AS j, round(sum(a.weight * b.weight), 6) AS w FROM ok a JOIN ok b ON a.rec_id = b.rec_id AND a.term = b.term AND a.seg_id < b.seg_id GROUP BY ALL""")(
    lambda s, d: A.sentence_graph(segs(s, d)).select("rec_id", "i", "j", F.round("w", 6).alias("w")))


def _rank_sql() -> str:
    """Thirty-two rounds as so many materialised tables."""
    base = _UNITS + _TFIDF + """, ok AS (SELECT v.* FROM v JOIN df USING (rec_id, term) WHERE df <= greatest(2, floor(0.35 * n))), e AS (SELECT a.rec_id, a.seg_id AS i, b.seg_id AS j, sum(a.weight * b.weight) AS w FROM ok a JOIN ok b ON a.rec_id = b.rec_id AND a.term = b.term AND a.seg_id <> b.seg_id GROUP BY ALL),
p AS MATERIALIZED (SELECT rec_id, i, j, w / sum(w) OVER (PARTITION BY rec_id, i) AS p FROM e), r0 AS MATERIALIZED (SELECT rec_id, seg_id, 1.0::DOUBLE / n AS r, n FROM units JOIN nn USING (rec_id))"""
    for k in range(32):
        base += f", r{k + 1} AS MATERIALIZED (SELECT u.rec_id, u.seg_id, 0.15 / u.n + 0.85 * coalesce(m.s, 0) AS r, u.n FROM r{k} u LEFT JOIN (SELECT p.rec_id, p.j, sum(q.r * p.p) AS s FROM p JOIN r{k} q ON q.rec_id = p.rec_id AND q.seg_id = p.i GROUP BY ALL) m ON m.rec_id = u.rec_id AND m.j = u.seg_id)"
    return base + " SELECT rec_id, seg_id, round(CASE WHEN n = 1 THEN 1 ELSE r END, 6) AS rank FROM r32"


query("textrank", _rank_sql())(lambda s, d: A.textrank(segs(s, d)).select("rec_id", "seg_id", F.round("rank", 6).alias("rank")))
query("summary")(lambda s, d: A.summarize(segs(s, d)))
_SAID = r"""said2 AS (SELECT rec_id, seg_id, unnest(raws) AS raw, unnest(range(1, len(raws) + 1)) AS ix FROM (SELECT rec_id, seg_id, list_filter(regexp_extract_all(text, '(?i)[0-9a-zà-öø-ÿ]{2,}'), lambda y: length(strip_accents(lower(y))) >= 3 AND NOT regexp_full_match(y, '[0-9]+') AND strip_accents(lower(y)) NOT IN (""" + _STOP + r""")) AS raws FROM units)),
k AS (SELECT *, strip_accents(lower(raw)) AS term FROM said2), ones AS (SELECT rec_id, term, count(*) AS c, min((seg_id, ix)) AS f, arg_min(raw, (seg_id, ix)) AS raw FROM k GROUP BY ALL),
tw AS (SELECT *, lead(term) OVER w AS r, lead(raw) OVER w AS raw2 FROM k WINDOW w AS (PARTITION BY rec_id, seg_id ORDER BY ix)),
pr AS (SELECT rec_id, term AS l, r, count(*) AS c, min((seg_id, ix)) AS f, arg_min(raw || ' ' || raw2, (seg_id, ix)) AS raw FROM tw WHERE r IS NOT NULL GROUP BY rec_id, term, r HAVING count(*) >= 3),
kept AS (SELECT pr.*, coalesce(d1.idf, 0.5) + coalesce(d2.idf, 0.5) AS idf FROM pr JOIN ones a ON a.rec_id = pr.rec_id AND a.term = l JOIN ones b ON b.rec_id = pr.rec_id AND b.term = r LEFT JOIN df d1 ON d1.rec_id = pr.rec_id AND d1.term = l LEFT JOIN df d2 ON d2.rec_id = pr.rec_id AND d2.term = r WHERE pr.c >= 0.6 * least(a.c, b.c)),
gone AS (SELECT rec_id, l AS term FROM kept UNION SELECT rec_id, r FROM kept),
al AS (SELECT rec_id, (1 + ln(c)) * idf * 0.75 AS w, c, f, array_to_string([CASE WHEN i > 1 AND lower(x) IN (""" + ",".join(f"'{w}'" for w in T.SMALL_WORDS) + r""") THEN lower(x) ELSE upper(lower(x)[1]) || lower(x)[2:] END for x, i in string_split(raw, ' ')], ' ') AS termo, 1 AS kind FROM kept
UNION ALL SELECT ones.rec_id, (1 + ln(c)) * coalesce(df.idf, 0.5), c, f, raw, 0 FROM ones LEFT JOIN df USING (rec_id, term) ANTI JOIN gone ON gone.rec_id = ones.rec_id AND gone.term = ones.term),
rk AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY round(w, 10) DESC, kind, f) AS pos FROM al)
SELECT rec_id, pos, termo, c AS ocorrencias, round(w / max(w) OVER (PARTITION BY rec_id), 3) AS peso FROM rk WHERE pos <= 14"""
query("keywords", _UNITS + _TFIDF + ", " + _SAID)(lambda s, d: A.keywords(segs(s, d)))
query("topic_similarity")(lambda s, d: A.topic_similarity(_sentences(s, d)))
query("chapters")(lambda s, d: A.chapters(_sentences(s, d), 5_000))


def _sentences(s, d):
    """Turns cut at full stops, timed by their place."""
    parts = segs(s, d).select("rec_id", "seg_id", "speaker", "start_ms", "end_ms", F.posexplode(F.split("text", r"(?<=\.) ")).alias("k", "text"))
    n = F.row_number().over(W.partitionBy("rec_id").orderBy("seg_id", "k")).cast("bigint")
    return parts.withColumn("n", n).select("rec_id", F.col("n").alias("seg_id"), "speaker", ((F.col("n") - 1) * 3000).alias("start_ms"), (F.col("n") * 3000).alias("end_ms"), "text")


def _re2(p: str) -> str:
    """The pattern for an engine whose word borders are ASCII."""
    p = re.sub(r"\\w", r"[\\p{L}\\p{N}_]", p)
    return p.replace(r"\b", "(?:^|$|[^\\p{L}\\p{N}_])", 1)[::-1].replace(r"\b"[::-1], "(?:$|[^\\p{L}\\p{N}_])"[::-1], 1)[::-1]


_SCORE = " + ".join(f"CASE WHEN regexp_matches(text, '(?i){_re2(p)}') THEN {w} ELSE 0.0 END" for p, w in A.COMMITMENTS)
query("action_items", _SEG + f""" SELECT rec_id, seg_id, speaker, start_ms, trim(text) AS texto, round(peso, 1) AS peso FROM (SELECT *, CAST({_SCORE} AS DOUBLE) AS peso FROM segments WHERE {_WORDS.format('text')} >= 4) WHERE peso >= 3 QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY peso DESC, seg_id) <= 12""")(lambda s, d: A.action_items(segs(s, d)))
query("questions", _SEG + f" SELECT rec_id, seg_id, speaker, start_ms, trim(text) AS texto FROM segments WHERE ends_with(trim(text), '?') AND {_WORDS.format('text')} >= 3 QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY seg_id) <= 15")(lambda s, d: A.questions(segs(s, d)))

# ---- search ----------------------------------------------------------------------------------------------

_POST = ", tk AS (SELECT rec_id, seg_id, start_ms, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS t FROM segments), post AS (SELECT rec_id, seg_id, start_ms, len(t) AS n, unnest(t) AS token, unnest(range(len(t))) AS pos FROM tk)"
query("postings", _SEG + _POST + " SELECT token, count(*) AS n, count(DISTINCT (rec_id, seg_id)) AS df FROM post GROUP BY token")(lambda s, d: S.postings(segs(s, d)).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rec_id", "seg_id").alias("df")))
_BM = ", hit AS ({hit}), tf AS (SELECT rec_id, seg_id, term, count(*) AS f, any_value(n) AS n FROM hit GROUP BY rec_id, seg_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), tot AS (SELECT count(*) AS nn, avg(len(t)) AS a FROM tk), sc AS (SELECT rec_id, seg_id, -round(sum(greatest(1e-6, ln((nn - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / a))), 9) AS score, count(*) AS k FROM tf JOIN df USING (term), tot GROUP BY rec_id, seg_id) SELECT rec_id, seg_id, start_ms, round(score, 6) AS score FROM sc JOIN tk USING (rec_id, seg_id) WHERE k = {k} ORDER BY sc.score, start_ms, rec_id, seg_id LIMIT 60"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("rec_id", "seg_id", "start_ms", F.round("score", 6).alias("score"))


_INDEXES: dict[tuple[str, str], Snapshots] = {}


def _index(s, d) -> Snapshots:
    """The stored index of a folder's transcripts: made once a session, then searched."""
    key = s.sparkContext.applicationId, d
    if key not in _INDEXES:
        store = S.index_store(s, scratch(s), {"recordings": ("rec_id",)})
        rows = segs(s, d)
        S.index_commit(store, rows, rows.select("rec_id"), {"recordings": lambda made: adapters.recordings(made("segments"))})
        _INDEXES[key] = store
    return _INDEXES[key]


query("index_totals", _SEG + _POST + " SELECT (SELECT count(*) FROM tk) AS segments, (SELECT count(*) FROM post) AS tokens, (SELECT count(*) FROM (SELECT DISTINCT token, rec_id, seg_id FROM post)) AS postings")(
    lambda s, d: _index(s, d).read("postings").agg(F.count(F.lit(1)).alias("postings")).select(F.lit(_index(s, d).version()["notes"]["index"][0]).cast("bigint").alias("segments"), F.lit(_index(s, d).version()["notes"]["index"][1]).cast("bigint").alias("tokens"), "postings"))
query("search_prefix", _SEG + _POST + _BM.format(hit="SELECT *, 0 AS term FROM post WHERE starts_with(token, 'contrat') UNION ALL SELECT *, 1 FROM post WHERE starts_with(token, 'envi')", k=2))(lambda s, d: _hits(S.search_index(_index(s, d), "contrat Envi")))
query("search_phrase", _SEG + _POST + _BM.format(hit="SELECT a.*, 0 AS term FROM post a JOIN post b USING (rec_id, seg_id) WHERE a.token = 'ate' AND b.token = 'sexta' AND b.pos = a.pos + 1", k=1))(lambda s, d: _hits(S.search_index(_index(s, d), '"até sexta"')))
query("search_one", _SEG + _POST + _BM.format(hit="SELECT *, 0 AS term FROM post WHERE starts_with(token, 'the')", k=1))(lambda s, d: _hits(S.search(segs(s, d), "the")))
query("search_like", _SEG + " SELECT rec_id, seg_id, start_ms, text FROM segments WHERE contains(strip_accents(lower(text)), 'ate sexta') ORDER BY start_ms, rec_id, seg_id LIMIT 60")(lambda s, d: S.search_like(segs(s, d), "Até sexta"))
query("search_orphans", _SEG + _POST + _BM.format(hit="SELECT *, 0 AS term FROM post WHERE starts_with(token, 'relatorio')", k=1).replace(" SELECT rec_id, seg_id, start_ms, round(score, 6) AS score FROM", " SELECT rec_id, seg_id, CASE WHEN rec_id % 2 = 0 THEN 'gravacao_' || rec_id || '.wav' ELSE '(removido)' END AS arquivo FROM"))(
    lambda s, d: S.search(segs(s, d), "relatorio", adapters.recordings(segs(s, d)).filter("rec_id % 2 = 0")).select("rec_id", "seg_id", "arquivo"))
query("search_snippets")(lambda s, d: S.search(segs(s, d), "relatorio pendente").select("rec_id", "seg_id", "trecho"))

# ---- store -------------------------------------------------------------------------------------------------


def _edits(s, d):
    e = segs(s, d).filter("seg_id % 5 = 0").select("rec_id", "seg_id", F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), t.alias("text")) for i, t in enumerate((F.lit("antigo"), F.when(F.col("rec_id") % 3 == 0, F.lit(" ")).when(F.col("rec_id") % 3 == 1, F.col("text")).otherwise(F.lit("Texto novo."))))])).alias("e"))
    return e.select("rec_id", "seg_id", "e.ordinal", "e.text")


query("edits_merge")(lambda s, d: R.apply_edits(segs(s, d), _edits(s, d)).select("rec_id", "seg_id", "text", "editado"))
# texts and edits are cleaned first, so an edit that says the same again is the same text in all recordings
query("edits_marked", _SEG + r""" SELECT rec_id, seg_id, (seg_id % 5 = 0 AND rec_id % 3 = 2) AS editado FROM segments""")(
    lambda s, d: R.apply_edits(segs(s, d).withColumn("text", T.clean_text(F.col("text"))), _edits(s, d).withColumn("text", T.clean_text(F.col("text")))).select("rec_id", "seg_id", "editado"))
query("upsert_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")(
    lambda s, d: R.latest(adapters.table(s, d, "events"), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type"))
query("restore_antijoin", "SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus IN ('P', 'O') THEN 'erro' ELSE 'concluido' END AS status FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")(
    lambda s, d: R.rescue(adapters.table(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), "o_custkey", F.when(F.col("o_orderstatus") == "P", "na_fila").when(F.col("o_orderstatus") == "O", "processando").otherwise("concluido").alias("status")), adapters.table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("job_id", "status"))
query("retention_delete", "SELECT o_orderkey FROM orders WHERE epoch(o_orderdate) < 820454400 - 24 * 3600")(
    lambda s, d: R.expired(adapters.table(s, d, "orders").withColumn("modified_s", F.unix_seconds(F.col("o_orderdate").cast("timestamp"))), 820454400, 24).select("o_orderkey"))
query("upload_check", "SELECT page_id AS ordinal, CASE WHEN page_id % 4 = 3 THEN 'formato' WHEN length(html) > 20000 THEN 'grande' END AS motivo FROM pages")(
    lambda s, d: R.uploads(adapters.table(s, d, "pages").select(F.col("page_id").alias("ordinal"), F.concat("page_id", F.when(F.col("page_id") % 4 == 3, ".exe").otherwise(".WAV")).alias("filename"), F.length("html").alias("size_bytes")), [".wav"], 20000).select("ordinal", "motivo"))
query("cascade_delete", _SEG + " SELECT rec_id, count(*) AS n FROM segments WHERE rec_id % 10 <> 0 GROUP BY rec_id")(
    lambda s, d: R.delete({"segments": segs(s, d)}, segs(s, d).filter("rec_id % 10 = 0"))["segments"].groupBy("rec_id").agg(F.count(F.lit(1)).alias("n")))

# ---- voices ------------------------------------------------------------------------------------------------


def _vec(s, d):
    return adapters.table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))


_CENT = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), s AS (SELECT label, i, sum(x) AS s FROM x GROUP BY ALL), c AS (SELECT label, i, s / sqrt(sum(s * s) OVER (PARTITION BY label)) AS c FROM s)"
query("centroids", f"WITH {_CENT} SELECT label, i, round(c, 6) AS c FROM c")(lambda s, d: V.centroids(_vec(s, d)).select("label", F.posexplode("c").alias("i", "c")).select("label", F.col("i").cast("bigint").alias("i"), F.round("c", 6).alias("c")))
query("nearest_centroid", f"WITH {_CENT}, m AS (SELECT vec_id, c.label, round(sum(x * c), 9) AS sim FROM x JOIN c USING (i) GROUP BY ALL) SELECT vec_id, arg_min(label, (-sim, label)) AS nearest, round(max(sim), 6) AS similarity FROM m GROUP BY vec_id")(
    lambda s, d: V.nearest_centroid(_vec(s, d), V.centroids(_vec(s, d)), "vec_id").select("vec_id", "nearest", F.round("similarity", 6).alias("similarity")))
query("voice_clusters")(lambda s, d: V.cluster(_vec(s, d).select(F.floor(F.col("vec_id") / 100).cast("bigint").alias("rec_id"), F.col("vec_id").alias("seg_id"), "v", F.lit(2000).alias("span_ms"))))
query("waveform", """WITH r AS (SELECT (user_id % 3) AS rec_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1 AS i, value FROM events), n AS (SELECT rec_id, greatest(1, count(*) // 50) AS per FROM r GROUP BY rec_id), p AS (SELECT rec_id, i // per AS point, max(abs(value)) AS p FROM r JOIN n USING (rec_id) GROUP BY ALL), q AS (SELECT rec_id, quantile_cont(p, 0.99) AS q FROM p GROUP BY rec_id)
SELECT rec_id, point, round(least(1.0, p / CASE WHEN q = 0 THEN 1 ELSE q END), 3) AS peak FROM p JOIN q USING (rec_id) WHERE point < 50""")(
    lambda s, d: V.waveform(adapters.table(s, d, "events").select((F.col("user_id") % 3).alias("rec_id"), (F.row_number().over(W.partitionBy(F.col("user_id") % 3).orderBy("ts", "event_id")) - 1).alias("i"), F.col("value").alias("x")), 50))

# ---- exports -------------------------------------------------------------------------------------------------

_LINE = "'[' || {ts} || ' - ' || {te} || '] ' || speaker || ': ' || text"
_TE = _TS.replace("start_ms", "end_ms")
query("export_txt_timestamps", _SEG + f" SELECT rec_id, string_agg({_LINE.format(ts=_TS, te=_TE)}, chr(10) ORDER BY seg_id) || chr(10) AS content FROM segments GROUP BY rec_id")(lambda s, d: X.txt_timestamps(segs(s, d)))
query("export_tsv", _SEG + " SELECT rec_id, 'start' || chr(9) || 'end' || chr(9) || 'speaker' || chr(9) || 'confidence' || chr(9) || 'text' || chr(10) || string_agg(printf('%.3f', start_ms / 1000.0) || chr(9) || printf('%.3f', end_ms / 1000.0) || chr(9) || speaker || chr(9) || printf('%.3f', confidence) || chr(9) || translate(text, chr(9) || chr(10), '  '), chr(10) ORDER BY seg_id) || chr(10) AS content FROM segments GROUP BY rec_id")(lambda s, d: X.tsv(segs(s, d)))
_LONG = "CASE WHEN duration_ms // 3600000 > 0 THEN (duration_ms // 3600000) || 'h ' || lpad((duration_ms // 60000 % 60)::VARCHAR, 2, '0') || 'min' ELSE (duration_ms // 60000) || 'min ' || lpad((duration_ms // 1000 % 60)::VARCHAR, 2, '0') || 's' END"
query("export_md", _SEG + _REC + f""", t AS (SELECT rec_id, '## Transcrição' || chr(10) || chr(10) || string_agg('**`' || {_TS} || '`** **' || speaker || '** ' || text || chr(10), chr(10) ORDER BY seg_id) AS body FROM segments GROUP BY rec_id)
SELECT rec_id, '# ' || filename || chr(10) || chr(10) || '- **Duração:** ' || {_LONG} || chr(10) || '- **Palavras:** ' || word_count || chr(10) || '- **Confiança média:** ' || CAST(round_even(CAST(CAST(coalesce(avg_confidence, 0) AS DECIMAL(9,6)) * 100 AS DOUBLE), 0) AS INT) || '%' || chr(10) || '- **Falantes identificados:** ' || speakers || chr(10) || chr(10) || '---' || chr(10) || chr(10) || body AS content FROM recs JOIN t USING (rec_id)""")(
    lambda s, d: X.md(segs(s, d), adapters.recordings(segs(s, d))))
_SEGCUES = "seg_id::VARCHAR || chr(10) || {ts} || ' --> ' || {te} || chr(10) || text || chr(10)"
query("export_srt_segments", _SEG + " SELECT rec_id, string_agg(" + _SEGCUES.format(ts=_TS + " || ',' || lpad((start_ms % 1000)::VARCHAR, 3, '0')", te=_TE + " || ',' || lpad((end_ms % 1000)::VARCHAR, 3, '0')") + ", chr(10) ORDER BY seg_id) AS content FROM segments GROUP BY rec_id")(
    lambda s, d: X.srt(segs(s, d).select("rec_id", F.col("seg_id").alias("cue_id"), "start_ms", "end_ms", F.array("text").alias("lines"))))
for _name, (_rel, _f) in X.BUILDERS.items():
    if _name not in ("txt_timestamps", "tsv", "md"):
        query(f"export_{_name}")(lambda s, d, f=_f, rel=_rel: f({"reading": Q.reading, "segments": lambda x: x, "cues": Q.build_cues}[rel](segs(s, d, rel == "cues"))))
query("export_resumo")(lambda s, d: X.summary_md(adapters.recordings(segs(s, d)), A.analyze(segs(s, d))))
_FORMATS = ", ".join(str(f) for f in media.FORMATS)
query("formats", _SEG + _REC + f""" SELECT rec_id, formato, rotulo, regexp_replace(filename, '\\.[^.]*$', '') || sufixo || extensao AS arquivo, word_count AS palavras, duration_ms
FROM recs CROSS JOIN (VALUES {_FORMATS}) f(formato, rotulo, sufixo, extensao)""")(
    lambda s, d: media.formats(adapters.recordings(segs(s, d))))

# ---- live ----------------------------------------------------------------------------------------------------


def _events(s, d):
    e = adapters.table(s, d, "events")
    status = F.when(F.col("event_type") == "purchase", "concluido").otherwise("processando")
    return e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"), F.floor(F.col("value") / 40).cast("bigint").alias("percent"), F.lit("x").alias("stage"), F.lit("y").alias("detail"))


query("live_status_changes", """WITH e AS (SELECT user_id::VARCHAR AS job_id, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'concluido' ELSE 'processando' END AS status, CAST(floor(value / 40) AS BIGINT) AS percent FROM events),
l AS (SELECT *, lag(status) OVER w AS ps, lag(percent) OVER w AS pp FROM e WINDOW w AS (PARTITION BY job_id ORDER BY seq))
SELECT job_id, seq, status, percent, status = 'concluido' AS final FROM l WHERE ps IS NULL OR ps = 'concluido' OR ps <> status OR pp IS DISTINCT FROM percent""")(lambda s, d: live.status_changes_batch(_events(s, d)).select("job_id", "seq", "status", "percent", "final"))
query("paced_progress", "SELECT user_id::VARCHAR AS job_id, event_id AS seq, CAST(floor(max(15 + least(79.0, value / 1000 * 80)) OVER (PARTITION BY user_id ORDER BY event_id)) AS BIGINT) AS progress FROM events")(
    lambda s, d: live.paced(adapters.table(s, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("value").alias("position_s"), F.lit(1000.0).alias("total_s"))).select("job_id", "seq", "progress"))

# ---- views ---------------------------------------------------------------------------------------------------

query("search_like_recordings", _SEG + _REC + """ SELECT s.rec_id, seg_id, start_ms, text, filename, created_at FROM segments s LEFT JOIN (SELECT * FROM recs WHERE rec_id % 2 = 0) r ON r.rec_id = s.rec_id
WHERE contains(strip_accents(lower(text)), 'ate sexta') ORDER BY created_at DESC NULLS LAST, start_ms, s.rec_id, seg_id LIMIT 60""")(
    lambda s, d: S.search_like(segs(s, d), "Até sexta", recordings=adapters.recordings(segs(s, d)).filter("rec_id % 2 = 0")).select("rec_id", "seg_id", "start_ms", "text", "filename", "created_at"))
query("visible_segments", _SEG + " SELECT rec_id, seg_id FROM segments WHERE contains(lower(text), 'você') AND confidence < 0.55 AND speaker <> 'system'")(lambda s, d: view.visible(segs(s, d), " VOCÊ ", ["system"], True).select("rec_id", "seg_id"))
query("neighbours", _SEG + " SELECT rec_id, min(start_ms) FILTER (start_ms > 20150) AS next_ms, coalesce(max(start_ms) FILTER (start_ms < 18800), 0) AS previous_ms FROM segments GROUP BY rec_id")(lambda s, d: view.neighbours(segs(s, d), 20000))
query("live_fields", _SEG + f" SELECT rec_id, seg_id AS id, start_ms, end_ms, {_TS} AS start_str, {_TE} AS end_str, text, confidence FROM segments")(lambda s, d: view.live_fields(segs(s, d)))
_BYTES = " ".join(f"WHEN b < {1024 ** (k + 1)} THEN printf('%.1f', round(b / {1024 ** k}.0::DOUBLE, 1)) || ' {u}'" for k, u in enumerate(L.BYTE_UNITS) if 1 <= k < 4)
query("figure_labels", f"""SELECT o_orderkey, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN b || ' B' {_BYTES} ELSE printf('%.1f', round(b / {1024 ** 4}.0::DOUBLE, 1)) || ' TB' END AS bytes,
CASE WHEN t >= 3600 THEN (t // 3600) || ':' ELSE '' END || lpad((t % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') AS clock,
CASE WHEN t = 0 THEN '—' WHEN t >= 3600 THEN (t // 3600) || 'h ' || ((t % 3600 + 30) // 60) || 'min' ELSE greatest(1, (t + 30) // 60) || 'min' END AS lasts,
CASE o_orderstatus WHEN 'F' THEN 'concluído' WHEN 'P' THEN 'na fila' ELSE 'O' END AS status, replace(format('{{:,}}', b), ',', '.') AS figure
FROM (SELECT o_orderkey, o_orderstatus, (o_orderkey - 1) * o_custkey * 977 AS b, o_custkey * 37 % 9000 AS t FROM orders)""")(
    lambda s, d: adapters.table(s, d, "orders").select("o_orderkey", ((F.col("o_orderkey") - 1) * F.col("o_custkey") * 977).alias("b"), (F.col("o_custkey") * 37 % 9000).alias("t"), F.when(F.col("o_orderstatus") == "F", "concluido").when(F.col("o_orderstatus") == "P", "na_fila").otherwise("O").alias("st")).select(
        "o_orderkey", L.bytes_label(F.col("b")).alias("bytes"), L.clock(F.col("t")).alias("clock"), L.rough_duration(F.col("t")).alias("lasts"), L.status_label(F.col("st")).alias("status"), L.whole_number(F.col("b")).alias("figure")))
query("vocabulary_terms", "SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name || ' ; ' || p_type || ',, ' || p_brand || ';', ';', ','), ','), lambda x: trim(x)), lambda x: x <> '') AS terms FROM part")(
    lambda s, d: adapters.table(s, d, "part").select("p_partkey", L.vocabulary_terms(F.concat("p_name", F.lit(" ; "), "p_type", F.lit(",, "), "p_brand", F.lit(";"))).alias("terms")))
query("completion_detail", _SEG + _REC + " SELECT rec_id, word_count || ' palavras em ' || segment_count || ' trechos' || CASE WHEN speakers > 2 THEN ' · ' || speakers || ' falante(s)' ELSE '' END || CASE WHEN rec_id % 3 > 0 THEN ' · ' || rec_id % 3 || ' capítulos' ELSE '' END || '.' AS detail FROM recs")(
    lambda s, d: adapters.recordings(segs(s, d)).select("rec_id", L.completion_detail(F.col("word_count"), F.col("segment_count"), F.when(F.col("speakers") > 2, F.col("speakers")), F.col("rec_id") % 3).alias("detail")))
query("thinned_points", "WITH p AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS point, count(*) OVER (PARTITION BY user_id) AS n FROM events), b AS (SELECT rec_id, n, greatest(1, least(n, 7)) AS b, unnest(range(greatest(1, least(n, 7)))) AS bar FROM (SELECT DISTINCT rec_id, n FROM p)) SELECT rec_id, bar * n // b AS point, bar FROM b")(
    lambda s, d: view.thinned(adapters.table(s, d, "events").select(F.col("user_id").alias("rec_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint").alias("point")), 30))
_STAGES = ("Na fila", "Transcrevendo 3 de 9", "?", "Separando os falantes", "Finalizando agora")
query("stage_steps", f"WITH e AS (SELECT user_id AS job_id, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 END AS k FROM events) SELECT job_id, seq, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS step FROM e")(
    lambda s, d: view.steps(adapters.table(s, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.get(F.array(*[F.lit(x) for x in _STAGES]), (F.col("event_id") % 5).cast("int")).alias("stage"))).select("job_id", "seq", "step"))
query("merge_polled", "SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'concluido' ELSE 'na_fila' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 0 END AS percent, CASE WHEN o_orderkey % 3 <> 0 THEN 'Na fila' END AS stage FROM orders WHERE o_orderstatus = 'P'")(
    lambda s, d: view.merge_polled(*[adapters.table(s, d, "orders").filter(c).select(F.col("o_orderkey").alias("job_id"), F.lit(st).alias("status"), F.lit(pc).alias("percent"), F.lit(sg).cast("string").alias("stage")) for c, st, pc, sg in (("o_orderstatus = 'P'", "na_fila", 0, "Na fila"), ("o_orderkey % 3 = 0", "concluido", 100, None))]))
query("raw_totals", _SEG + """ SELECT rec_id, count(*) FILTER (NOT g) AS segments, count(*) FILTER (g) AS discarded, coalesce(sum(end_ms - start_ms) FILTER (NOT g), 0) AS speech_ms,
coalesce(round(CAST(avg(confidence::DECIMAL(9,6)) FILTER (NOT g AND confidence > 0) AS DECIMAL(18,10)), 3)::DOUBLE, 0) AS avg_confidence FROM (SELECT *, seg_id % 4 = 0 AS g FROM segments) GROUP BY rec_id""")(
    lambda s, d: view.raw_totals(segs(s, d).withColumn("text", F.when(F.col("seg_id") % 4 == 0, "Obrigado por assistir!").otherwise(F.col("text"))).withColumn("no_speech_prob", F.lit(0.1)).withColumn("avg_logprob", F.lit(-0.2))))
query("removed_jobs", "SELECT DISTINCT o_custkey AS job_id, 'Tarefa removida.' AS message FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")(
    lambda s, d: view.removed(adapters.table(s, d, "orders").select(F.col("o_custkey").alias("job_id")), adapters.table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("job_id"))))
query("paced_ahead", """WITH e AS (SELECT user_id AS job_id, event_id AS seq, row_number() OVER w * 3.0::DOUBLE AS t, CASE WHEN event_id % 4 = 0 THEN value END AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT *, coalesce(max(p) OVER w, 0) AS done FROM e WINDOW w AS (PARTITION BY job_id ORDER BY seq)), v AS (SELECT *, coalesce(last_value(CASE WHEN p IS NOT NULL AND t > 5 AND done > 0 THEN done / t END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 1.0) AS x FROM c)
SELECT job_id, seq, round(max(15 + least(79, greatest(done, least(1000.0, t * x, done + 240)) / 1000.0 * 80)) OVER (PARTITION BY job_id ORDER BY seq), 6) AS progress FROM v""")(
    lambda s, d: live.paced_ahead(adapters.table(s, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) * 3.0).alias("elapsed_s"), F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("position_s"), F.lit(1000.0).alias("total_s"))).select("job_id", "seq", F.round("progress", 6).alias("progress")))
