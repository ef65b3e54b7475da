"""Sources: WAV files as blocks of samples, media descriptions as structs, catalogs, configuration."""

from __future__ import annotations

import io
import os
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK_S = 30
MEDIA = ("mp3", "wav", "m4a", "ogg", "opus", "flac", "mp4", "mkv", "mov", "webm", "avi", "aac", "wma")
PROBE = "struct<format:struct<format_name:string,duration:string,size:string,bit_rate:string,tags:map<string,string>>,streams:array<struct<codec_type:string,codec_name:string,sample_rate:string,channels:int,duration:string,bit_rate:string>>>"


def files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = MEDIA) -> DataFrame:
    """Media files of a folder itself, not of its subfolders: path, modified_s, length (contents are not read)."""
    glob = "*.{" + ",".join(e for x in extensions for e in (x, x.upper())) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", F.unix_timestamp("modificationTime").alias("modified_s"), "length").orderBy("path")


def wav_header(content: bytes) -> dict:
    with wave.open(io.BytesIO(content)) as w:
        return {"rate": w.getframerate(), "channels": w.getnchannels(), "width": w.getsampwidth(), "frames": w.getnframes()}


def wav_blocks(content: bytes, seconds: int = BLOCK_S) -> Iterator[np.ndarray]:
    """Mono samples in [-1, 1]; channels are averaged, other widths than 16 bits are refused."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit samples")
        while raw := w.readframes(seconds * w.getframerate()):
            x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
            yield x.reshape(-1, w.getnchannels()).mean(1)


def read_wav(spark: SparkSession, folder: str) -> DataFrame:
    """(path, block, rate, samples array<float>)."""

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rate = wav_header(content)["rate"]
                for i, x in enumerate(wav_blocks(content)):
                    yield pd.DataFrame({"path": [path], "block": [i], "rate": [rate], "samples": [x]})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,WAV}").load(folder).select("path", "content")
    return raw.mapInPandas(run, "path string, block int, rate int, samples array<float>")


def describe(probes: DataFrame, column: str = "probe") -> DataFrame:
    """A media probe's JSON as columns: the first audio and video streams, the first duration that parses."""
    p = F.from_json(column, PROBE)
    first = lambda kind: F.get(F.filter(F.col("__p.streams"), lambda s: s["codec_type"] == kind), 0)
    d = probes.withColumn("__p", p).withColumn("__a", first("audio")).withColumn("__v", first("video"))
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    out = d.withColumn("duration", F.coalesce(number("__p.format.duration"), number("__a.duration"), F.lit(0.0))).withColumn("has_audio", F.col("__a").isNotNull()).withColumn("has_video", F.col("__v").isNotNull())
    out = out.withColumn("audio_codec", F.col("__a.codec_name")).withColumn("video_codec", F.col("__v.codec_name")).withColumn("sample_rate", F.expr("try_cast(__a.sample_rate AS INT)")).withColumn("channels", F.col("__a.channels"))
    tags = F.transform_keys("__p.format.tags", lambda k, _: F.lower(k))
    return out.withColumn("container", F.col("__p.format.format_name")).withColumn("titulo", F.try_element_at(tags, F.lit("title"))).drop("__p", "__a", "__v")


def dotenv(text: str, env: dict[str, str]) -> dict[str, str]:
    """``env`` over the KEY=value lines of a file's text: comments, lines without ``=`` and keys that env has do not count,
    quotes around values go, of a key's lines the first holds."""
    pairs = (line.strip().split("=", 1) for line in text.splitlines() if "=" in line and not line.strip().startswith("#"))
    named = [(k.strip(), v.strip().strip('"').strip("'")) for k, v in pairs]
    return {**{k: v for k, v in reversed(named) if k}, **env}


def setting(name: str, default, env: dict[str, str] | None = None):
    """An environment setting in the default's type; a decimal comma and words for yes are understood."""
    raw = (env if env is not None else os.environ).get(name, "").strip()
    if not raw:
        return default
    if isinstance(default, bool):
        return raw.lower() in ("1", "true", "yes", "sim", "on")
    try:
        return type(default)(raw.replace(",", ".") if isinstance(default, float) else raw)
    except ValueError:
        return default


#: Output formats: name, label, suffix of the file name, extension.
FORMATS = (
    ("txt", "Texto com parágrafos", "_transcricao", ".txt"), ("txt_timestamps", "Texto com marcações de tempo", "_transcricao_com_tempos", ".txt"),
    ("srt", "Legenda SRT", "_legendas", ".srt"), ("vtt", "Legenda WebVTT", "_legendas", ".vtt"), ("ass", "Legenda ASS (estilizada)", "_legendas", ".ass"),
    ("md", "Markdown", "_transcricao", ".md"), ("resumo", "Resumo e temas", "_resumo", ".md"), ("csv", "Planilha CSV", "_segmentos", ".csv"), ("tsv", "Tabela TSV", "_segmentos", ".tsv"),
    ("json", "JSON completo", "_dados", ".json"), ("html", "Página HTML", "_transcricao", ".html"), ("docx", "Documento Word", "_transcricao", ".docx"), ("pdf", "PDF", "_transcricao", ".pdf"),
)


def formats(recs: DataFrame) -> DataFrame:
    """(rec_id, formato, rotulo, arquivo, palavras, duration_ms): the file of each format that a recording gets, named after
    its own without the extension, and what it holds."""
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("formato", "rotulo", "sufixo", "extensao"), f, strict=True)]) for f in FORMATS])).alias("f")
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return recs.select("rec_id", stem.alias("stem"), each, "word_count", "duration_ms").select("rec_id", "f.formato", "f.rotulo", F.concat("stem", "f.sufixo", "f.extensao").alias("arquivo"), F.col("word_count").alias("palavras"), "duration_ms")
