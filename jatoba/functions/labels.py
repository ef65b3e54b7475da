"""How figures, states and times are shown: scalar rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from jatoba.functions.text import strip

# Fixed values.
STATUS = {"concluido": "concluído", "erro": "erro", "cancelado": "cancelado", "processando": "em andamento", "na_fila": "na fila"}
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")
JOB_ID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Stages by step; a stage belongs to the step that has a beginning of it.
PREPARING = ("Preparando", "Enviando", "Na fila", "Iniciando", "Analisando o arquivo", "Extraindo o áudio", "Carregando o modelo", "Baixando o modelo")
RECOGNISING = ("Transcrevendo", "Revisando o texto")
SEPARATING = ("Separando os falantes",)
CLOSING = ("Montando o documento", "Lendo o conteúdo", "Finalizando", "Concluído")


def status_label(c: Column) -> Column:
    """A state in words; one that is not known stays as it is."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[c], c)


def bytes_label(c: Column) -> Column:
    """Powers of 1024, one decimal from KB on; null and 0 are ``0 B``."""
    out = F.when(c.isNull() | (c == 0), F.lit("0 B")).when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
    shown = lambda k: F.format_string(f"%.1f {BYTE_UNITS[k]}", F.round(c / 1024**k, 1))
    for k in range(1, len(BYTE_UNITS) - 1):
        out = out.when(c < 1024 ** (k + 1), shown(k))
    return out.otherwise(shown(len(BYTE_UNITS) - 1))


def clock(seconds: Column) -> Column:
    """``mm:ss``, with hours ``h:mm:ss``; null, negative and non-finite times are zero."""
    bad = seconds.isNull() | F.isnan(seconds.cast("double")) | (F.abs(seconds.cast("double")) == float("inf")) | (seconds < 0)
    s = F.floor(F.when(bad, F.lit(0)).otherwise(seconds)).cast("bigint")
    base = F.format_string("%02d:%02d", F.floor(s % 3600 / 60).cast("bigint"), s % 60)
    return F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), base)).otherwise(base)


def rough_duration(seconds: Column) -> Column:
    """``2h 5min``, ``7min`` (at least one), a dash for nothing; minutes round half up, so ``1h 60min`` can occur."""
    h, m = F.floor(seconds / 3600).cast("bigint"), F.floor(seconds % 3600 / 60 + 0.5).cast("bigint")
    text = F.when(h > 0, F.format_string("%dh %dmin", h, m)).otherwise(F.format_string("%dmin", F.greatest(F.lit(1).cast("bigint"), m)))
    return F.when(seconds.isNull() | (seconds == 0), F.lit("—")).otherwise(text)


def whole_number(c: Column) -> Column:
    """Thousands by points; null is 0."""
    return F.translate(F.format_number(F.coalesce(c, F.lit(0)), 0), ",", ".")


def speed_label(c: Column) -> Column:
    return F.concat(F.translate(c.cast("string"), ".", ","), F.lit("×"))


def vocabulary_terms(c: Column) -> Column:
    """Terms between commas or semicolons, trimmed, none empty; null has none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: strip(x)), lambda x: x != "")


def is_job_id(c: Column) -> Column:
    """Null is no identifier."""
    return F.coalesce(c.rlike(JOB_ID) & ~c.endswith("\n"), F.lit(False))


def completion_detail(words: Column, segments: Column, speakers: Column, chapters: Column) -> Column:
    """Words and segments, then speakers and chapters where there are any."""
    part = lambda c, after: F.when(F.coalesce(c, F.lit(0)) > 0, F.concat(c.cast("string"), F.lit(after)))
    first = F.concat(words.cast("string"), F.lit(" palavras em "), segments.cast("string"), F.lit(" trechos"))
    return F.concat(F.concat_ws(" · ", first, part(speakers, " falante(s)"), part(chapters, " capítulos")), F.lit("."))


def stage_step(stage: Column, speakers: bool = True) -> Column:
    """The step (from 0) of a stage, null for one that belongs to none."""
    steps = [PREPARING, RECOGNISING, *([SEPARATING] if speakers else []), CLOSING]
    out = F.when(F.lit(False), F.lit(0))
    for i, names in enumerate(steps):
        for name in names:
            out = out.when(stage.startswith(name), F.lit(i))
    return out
