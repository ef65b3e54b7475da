import io
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jatoba.engine import Engine
from jatoba.operators import analytics, export, search, sequence, speakers, store
from jatoba.sources import adapters, media

WORD = "array<struct<word:string,start_ms:bigint,end_ms:bigint,probability:double>>"
SCHEMA = f"rec_id bigint, seg_id bigint, speaker string, start_ms bigint, end_ms bigint, text string, confidence double, words {WORD}"


def meeting(spark, texts, speaker=None, gap=0):
    rows, at = [], 0
    for i, t in enumerate(texts):
        words = [(w, at + 400 * k, at + 400 * (k + 1), 0.94) for k, w in enumerate(t.split())]
        end = at + 400 * len(words)
        rows.append((1, i + 1, speaker[i] if speaker else None, at, end, t, 0.91, words))
        at = end + gap
    return spark.createDataFrame(rows, SCHEMA)


def test_repeats_keep_two(spark):
    assert sequence.drop_repeated(meeting(spark, ["Obrigado.", "obrigado", "OBRIGADO!", "obrigado", "fim", "obrigado"])).count() == 4


def test_sentences_follow_words(spark):
    out = sequence.split_sentences(meeting(spark, ["Bom dia a todos. O Dr. Silva chegou. Vamos"])).orderBy("seg_id").collect()
    assert [r["text"] for r in out] == ["Bom dia a todos.", "O Dr. Silva chegou.", "Vamos"]
    assert out[1]["start_ms"] == 1600 and out[1]["end_ms"] == 3200


def test_cues_are_ordered_and_short(spark):
    cues = sequence.build_cues(meeting(spark, ["palavra " * 60 + "fim."])).orderBy("cue_id").collect()
    assert len(cues) > 3 and all(a["end_ms"] <= b["start_ms"] for a, b in zip(cues, cues[1:], strict=False))
    assert all(len(line) <= 42 for c in cues for line in c["lines"]) and all(c["end_ms"] > c["start_ms"] for c in cues)
    r = sequence.subtitle_report(sequence.build_cues(meeting(spark, ["palavra " * 60]))).first()
    assert r["blocos"] == sequence.build_cues(meeting(spark, ["palavra " * 60])).count() and r["sobrepostas"] == []


def test_turns_and_dialogue_and_paragraphs(spark):
    m = meeting(spark, ["Oi.", "Tudo bem?", "Sim.", "Ótimo. Fim."], ["A", "A", "B", "A"])
    assert [r["speaker"] for r in sequence.turns(m).orderBy("turn_id").collect()] == ["A", "B", "A"]
    assert [r["texto"] for r in sequence.dialogue(m).orderBy("pos").collect()] == ["Oi. Tudo bem?", "Sim.", "Ótimo. Fim."]
    assert sequence.paragraphs(meeting(spark, ["Frase curta."] * 12)).count() == 3
    assert sequence.paragraphs(meeting(spark, ["Frase."] * 3, gap=2000)).count() == 3


def test_topics(spark):
    topics = ["contrato cláusula jurídico assinatura", "servidor banco dados latência", "campanha anúncio público marca", "salário férias contratação vaga"]
    units = meeting(spark, [t + " deste bloco aqui" for t in topics for _ in range(10)], gap=10_000)
    ch = analytics.chapters(units, 60_000).orderBy("id").collect()
    assert len(ch) >= 2 and [c["start_ms"] for c in ch] == sorted(c["start_ms"] for c in ch) and all(c["titulo"] for c in ch)


def test_keywords_weights(spark):
    k = analytics.keywords(meeting(spark, ["A nota fiscal venceu hoje", "nota fiscal emitida", "pagamos a nota fiscal", "outro tema qualquer relatório"])).orderBy("pos").collect()
    assert k[0]["peso"] == 1.0 and all(0 < x["peso"] <= 1 for x in k)
    assert "Nota Fiscal" in [x["termo"] for x in k] and "nota" not in [x["termo"] for x in k]


def test_action_items_and_questions(spark):
    m = meeting(spark, ["Você ficou de enviar o contrato até sexta", "O céu está bonito hoje de manhã", "Podemos confirmar isso?", "Sim?"])
    assert [r["seg_id"] for r in analytics.action_items(m).collect()] == [1]
    assert [r["seg_id"] for r in analytics.questions(m).collect()] == [3]


def test_summary_is_chronological_and_diverse(spark, sf_dir):
    segs = adapters.segments(spark, sf_dir)
    s = analytics.summarize(segs, 3)
    assert s.groupBy("rec_id").count().agg(F.max("count")).first()[0] <= 3


def test_search_language(spark):
    assert search.parse("a") == [] and search.parse('"até  sexta"') == [search.Term(("ate", "sexta"), True)]
    assert search.parse("a.b pré-venda") == [search.Term(("ab",), False), search.Term(("pre", "venda"), False)]
    m = meeting(spark, ["O contrato será assinado", "A contratação da vaga", "   ", "pré-vendas do mês"])
    hit = lambda q: [r["seg_id"] for r in search.search(m, q).orderBy("seg_id").collect()]
    assert hit("contrat") == [1, 2] and hit("sera contrato") == [1] and hit('"será assinado"') == [1] and hit('"ser assinado"') == [] and hit("pre-vend") == [4] and hit("x") == []
    assert "<mark>contrato</mark>" in search.search(m, "contrato").first()["trecho"]


def test_store_is_idempotent(spark, tmp_path):
    m = meeting(spark, ["um dois", " ", "três"])
    e = Engine(spark, str(tmp_path))
    recs = spark.createDataFrame([(1, "a.wav", "concluido", 5, 600_000, 10, 0.9, 42)], "rec_id bigint, filename string, status string, created_at bigint, duration_ms bigint, word_count bigint, avg_confidence double, elapsed_s bigint")
    e.save(m.drop("words"), recs)
    e.save(m.drop("words"), recs)
    assert e.segments().count() == 2 and e.recordings().count() == 1 and e.summary().first()["total"] == 1
    assert e.search("tres").first()["arquivo"] == "a.wav"
    out = e.edit(spark.createDataFrame([(1, 3, 0, "x"), (1, 3, 1, "quatro ,cinco"), (1, 1, 0, "  ")], "rec_id bigint, seg_id bigint, ordinal int, text string"))["segments"].orderBy("seg_id").collect()
    assert [(r["text"], r["editado"]) for r in out] == [("um dois", False), ("quatro, cinco", True)]


def test_two_voices(spark):
    rng = np.random.default_rng(7)
    t = np.arange(2 * speakers.RATE) / speakers.RATE
    voice = lambda f: sum(np.sin(2 * np.pi * f * k * t) / k for k in range(1, 12)) * (0.6 + 0.4 * np.sin(8 * np.pi * t))
    x = np.concatenate([voice((110, 240)[i % 2]) for i in range(10)])
    x = (0.2 * x / np.abs(x).max() + rng.normal(0, 0.01, len(x))).astype(np.float32)
    audio = spark.createDataFrame([(1, 0, x.tolist())], "rec_id bigint, block int, samples array<float>")
    segs = spark.createDataFrame([(1, i + 1, None, i * 2000, (i + 1) * 2000, "fala", 0.9, []) for i in range(10)], SCHEMA)
    out = speakers.assign(segs, speakers.voices(audio, segs)).orderBy("seg_id").collect()
    ids = [r["speaker_id"] for r in out]
    assert sum(a != i % 2 for i, a in enumerate(ids)) in (0, 1, 9, 10) and out[0]["speaker"].startswith("Falante ")


def test_documents_are_well_formed(spark):
    m = meeting(spark, ['Olá "mundo"; tudo?', "Sim <b>"], ["A", "B"])
    made, failed = export.export({"segments": m, "cues": sequence.build_cues(m), "reading": sequence.reading(m)})
    assert not failed and set(made) == set(export.BUILDERS)
    text = {k: v.first()["content"] for k, v in made.items()}
    assert text["csv"].startswith("﻿#;") and '"Olá ""mundo""; tudo?"' in text["csv"] and "\r\n" in text["csv"] and "91%" in text["csv"]
    assert text["vtt"].startswith("WEBVTT\n\n") and "&lt;b&gt;" in text["html"] and text["srt"].startswith("1\n00:00:00,000 --> ")
    assert bytes(text["pdf"]).startswith(b"%PDF-") and bytes(text["pdf"]).rstrip().endswith(b"%%EOF")
    assert "word/document.xml" in zipfile.ZipFile(io.BytesIO(bytes(text["docx"]))).namelist()
    names = zipfile.ZipFile(io.BytesIO(bytes(export.zipped({k: made[k] for k in ("srt", "pdf")}, {}).first()["content"]))).namelist()
    assert sorted(names) == ["1.pdf", "1.srt"]


def test_media(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(np.tile(np.array([16384, -16384], "<i2"), 16000 * 31).tobytes())
    (tmp_path / "b.txt").write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in media.files(spark, str(tmp_path)).collect()] == ["a.wav"]
    rows = media.read_wav(spark, str(tmp_path)).orderBy("block").collect()
    assert [len(r["samples"]) for r in rows] == [480_000, 16_000] and set(rows[0]["samples"][:5]) == {0.0}
    probe = '{"format":{"format_name":"mp4","duration":"x","tags":{"TITLE":"Oi"}},"streams":[{"codec_type":"video","codec_name":"h264"},{"codec_type":"audio","codec_name":"aac","duration":"2.5","channels":2,"sample_rate":"48000"}]}'
    d = media.describe(spark.createDataFrame([(probe,)], "probe string")).first()
    assert (d["duration"], d["titulo"], d["audio_codec"], d["sample_rate"]) == (2.5, "Oi", "aac", 48000)
    assert media.setting("A", 1.0, {"A": "2,5"}) == 2.5 and media.setting("A", False, {"A": "sim"}) is True and media.setting("A", 3, {"A": "x"}) == 3


def test_history_deletes(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (None, 3, "z")], "job_id bigint, updated_at bigint, v string")
    assert [r["v"] for r in store.latest(a).collect()] == ["y"]
    assert store.expired(spark.createDataFrame([(100,), (0,)], "modified_s bigint"), 3700, 1).count() == 1
    assert store.expired(spark.createDataFrame([(0,)], "modified_s bigint"), 10**9, 0).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_agglomerate_small(n):
    v = np.eye(3)[:n]
    assert speakers.agglomerate(v) == list(range(n))


def test_a_format_that_fails_at_run_time_stops_no_other(spark, tmp_path):
    segs = meeting(spark, ["Bom dia.", "Até logo."])
    broken = segs.withColumn("text", F.when(F.col("seg_id") > 0, F.raise_error(F.lit("no text"))).otherwise(F.col("text")))
    done, failed = export.write({"segments": segs, "reading": broken.select("rec_id", F.col("seg_id").alias("pos"), F.col("text").alias("texto"))}, str(tmp_path), ["txt", "tsv", "srt", "csv"])
    assert sorted(done) == ["csv", "tsv"] and "no text" in failed["txt"] and "cues" in failed["srt"]
    assert "Bom dia." in spark.read.parquet(str(tmp_path / "tsv")).first().content


def test_written_documents_of_a_store(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    segs = meeting(spark, ["Bom dia a todos vocês.", "Vamos enviar o contrato até sexta."])
    engine.save(segs.drop("words"), adapters.recordings(segs))
    done, failed = engine.write_documents(segs, str(tmp_path / "docs"), ["resumo", "md"])
    assert sorted(done) == ["md", "resumo"] and not failed
    assert spark.read.parquet(str(tmp_path / "docs" / "resumo")).count() == 1


def test_voices_have_styles_of_their_own(spark):
    m = meeting(spark, ["Oi.", "Tudo {bem}?", "Sim."], ["Falante 1", "Falante 2", "Ana"])
    text = export.ass(sequence.build_cues(m)).first()["content"]
    assert [x.split(",")[0] for x in text.split("\n") if x.startswith("Style:")] == ["Style: Padrao", "Style: F1", "Style: F2"]
    assert [x.split(",")[3] for x in text.split("\n") if x.startswith("Dialogue:")] == ["F1", "F2", "Padrao"]
    assert export.ASS_COLOURS[0] in text and export.ASS_COLOURS[1] in text and "Tudo (bem)?" in text and text.index("[Events]") > text.index("Style: F2")
    assert export.ass(sequence.build_cues(meeting(spark, ["Oi."]))).first()["content"].count("\nStyle:") == 1


def test_recordings_without_speakers_are_read_in_paragraphs(spark):
    m = meeting(spark, ["Frase curta."] * 12)
    both = m.unionByName(meeting(spark, ["Oi.", "Olá."], ["A", "B"]).withColumn("rec_id", F.lit(2).cast("bigint")))
    text = {r["rec_id"]: r["content"] for r in export.txt(sequence.reading(both)).collect()}
    assert text[1].count("\n\n") == 2 and ":" not in text[1] and text[2] == "A: Oi.\n\nB: Olá.\n"


def test_markdown_and_summary_pages(spark):
    topics = ["contrato cláusula jurídico assinatura", "servidor banco dados latência", "campanha anúncio público marca"]
    m = meeting(spark, [f"{t} deste bloco aqui" for t in topics for _ in range(10)] + ["Você ficou de enviar o contrato até sexta?"], ["A", "B"] * 15 + ["A"], gap=10_000)
    recs = adapters.recordings(m).withColumn("model", F.lit("m")).withColumn("profile", F.lit("p")).withColumn("language", F.lit("pt"))
    made, failed = export.export({"segments": m, "recordings": recs, **analytics.analyze(m)}, ["md", "resumo"])
    assert not failed
    md, page = (made[k].first()["content"] for k in ("md", "resumo"))
    assert md.startswith("# gravacao_1.wav\n\n- **Duração:** ") and "- **Modelo:** m · perfil p\n- **Idioma:** pt\n- **Confiança média:** 91%\n- **Falantes identificados:** 2\n- **Ritmo:** " in md
    assert md.index("---") < md.index("## Capítulos") < md.index("## Transcrição") and md.rstrip().endswith("Você ficou de enviar o contrato até sexta?")
    heads = [x for x in page.split("\n") if x.startswith("#")]
    assert heads[0] == "# gravacao_1.wav — resumo" and heads[1:3] == ["## Em poucas linhas", "## Temas dominantes"] and heads[-2:] == ["## Participação", "## Números da gravação"]
    assert "| A | " in page and " ppm | " in page and "- [ ] `00:" in page and "A — Você ficou" in page and "% da duração)" in page


def test_parts_of_a_summary_page_are_made_in_tasks_of_their_own(spark):
    """Parts dealt alike by rec_id would be made one after another in one task: an exchange has to part them from the page."""
    m = meeting(spark, ["Bom dia a todos vocês.", "Vamos enviar o contrato até sexta."]).repartition(4, "rec_id")
    plan = export.summary_md(adapters.recordings(m), analytics.analyze(m))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(" in plan[: plan.index("Union")]


def test_pages_break_where_the_widths_say():
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz áéçãõ.,;ABCMWil日"))
    for _ in range(150):
        text = "".join(rng.choice(letters, rng.integers(0, 400)))
        if rng.random() < 0.2:
            text += " " + "".join(rng.choice(list("wWmi/"), 150))
        size, bold, width = float(rng.choice([8.5, 10.5, 20])), bool(rng.random() < 0.5), float(rng.choice([120, 483.28]))
        got = export.broken(text, width, size, bold)
        assert all(export.text_width(x, size, bold) <= width + 1e-6 or len(x) == 1 for x in got)
        want, rest = [], text.split()
        while rest:  # the longest line that fits, by trying all
            k = max((k for k in range(1, len(rest) + 1) if export.text_width(" ".join(rest[:k]), size, bold) <= width + 1e-9), default=0)
            if k:
                want.append(" ".join(rest[:k]))
                rest = rest[k:]
            else:
                cut = max((c for c in range(1, len(rest[0])) if export.text_width(rest[0][:c], size, bold) <= width + 1e-9), default=1)
                want.append(rest[0][:cut])
                rest[0] = rest[0][cut:]
        assert got == (want or [""])
    pages = export.laid_out("Título", [("Ana", "palavra " * 400), ("", "fim " * 900)])
    assert len(pages) > 1 and all(export.MARGIN - 1e-6 <= y <= export.PAGE[1] - export.MARGIN and x + export.text_width(t, s, b) <= export.PAGE[0] - export.MARGIN + 1e-6 for p in pages for x, y, t, s, b in p)
    raw = export.pdf_bytes("Título (1)", [("Ana", "Olá \\ (mundo) " * 300)])
    start = int(raw.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    rows = raw[start:].split(b"\n")
    assert rows[0] == b"xref"
    for i, row in enumerate(rows[3 : 2 + int(rows[1].split()[1])], 1):
        assert raw[int(row[:10]) :].startswith(b"%d 0 obj" % i)


def test_binary_documents_are_sent_a_few_at_a_time(monkeypatch):
    """However many recordings a batch has, a task holds few of their documents."""
    monkeypatch.setattr(export, "DOCUMENT_BYTES", 3000)
    batch = pa.record_batch([pa.array(range(50)), pa.array([["Ana"]] * 50), pa.array([[f"texto {i}"] for i in range(50)])], ["rec_id", "who", "said"])
    sent = list(export._made(iter([batch]), export.pdf_bytes))
    assert len(sent) > 10 and max(sum(map(len, b.column("content").to_pylist())) for b in sent) < 6000
    got = [x for b in sent for x in zip(b.column("rec_id").to_pylist(), b.column("content").to_pylist(), strict=True)]
    assert got == [(i, export.pdf_bytes(f"Transcrição {i}", [("Ana", f"texto {i}")])) for i in range(50)]
