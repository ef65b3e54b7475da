"""The facade: what an application calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from jatoba.functions import labels as L, text as T
from jatoba.operators import analytics, export, search, sequence, speakers, store
from jatoba.operators.snapshot import Snapshots

#: What an engine keeps beside the relations of the search index.
ORDERS = {"recordings": ("rec_id",), "documents": ("rec_id", "format")}


class Engine:
    """Over a folder of versioned relations: segments, postings, sizes, recordings and documents change together."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store: Snapshots = search.index_store(spark, root, ORDERS)

    def segments(self) -> DataFrame:
        return self.store.read("segments")

    def recordings(self) -> DataFrame:
        return self.store.read("recordings")

    def documents(self) -> DataFrame:
        """(rec_id, format, content binary)."""
        return self.store.read("documents")

    def transcribe(self, raw: DataFrame, voices: DataFrame | None = None, vocabulary: tuple[str, ...] = (), fillers: bool = True) -> dict[str, DataFrame]:
        """From decoder output (segments with words, no_speech_prob, avg_logprob) to every relation of a result."""
        clean = sequence.drop_hallucinations(raw.withColumn("text", T.clean_text(F.col("text"))))
        segs = sequence.renumber(sequence.drop_repeated(sequence.split_sentences(clean)))
        if voices is not None:
            segs = speakers.assign(segs, voices)
        if not fillers:
            segs = segs.withColumn("text", T.strip_fillers(F.col("text")))
        if vocabulary:
            segs = segs.withColumn("text", T.apply_vocabulary(F.col("text"), vocabulary))
        return self.derive(segs)

    def derive(self, segs: DataFrame) -> dict[str, DataFrame]:
        cues = sequence.build_cues(segs)
        return {"segments": segs, "cues": cues, "report": sequence.subtitle_report(cues), "paragraphs": sequence.paragraphs(segs), "dialogue": sequence.dialogue(segs), "turns": sequence.turns(segs), **analytics.analyze(segs)}

    def _documents(self, segs: DataFrame, recs: DataFrame, formats: Sequence[str]) -> DataFrame:
        made, failed = export.export(self._relations(segs, recs, formats), list(formats))
        if failed:
            raise ValueError(f"no documents of {sorted(failed)}: {failed}")
        each = [df.select("rec_id", F.lit(name).alias("format"), F.col("content").cast("binary").alias("content")) for name, df in made.items()]
        out = each[0]
        for df in each[1:]:
            out = out.unionByName(df)
        return out

    def _relations(self, segs: DataFrame, recs: DataFrame, formats: Sequence[str] | None) -> dict[str, DataFrame]:
        """What the documents of these formats (None: all) are made of; the analysis has the largest plans."""
        needed = {export.BUILDERS[f][0] for f in (formats if formats is not None else export.BUILDERS) if f in export.BUILDERS}
        made = {"segments": segs}
        if "cues" in needed:
            made["cues"] = sequence.build_cues(segs)
        if "reading" in needed:
            made["reading"] = sequence.reading(segs)
        if formats is None or {"resumo", "md"} & set(formats):
            made["recordings"] = recs
        if formats is None or "resumo" in formats:
            made |= analytics.analyze(segs)
        elif "md" in formats:
            made |= {"capitulos": analytics.chapters(segs), "estatisticas": analytics.statistics(segs)}
        return made

    def _commit(self, segs: DataFrame, recs: DataFrame, formats: Sequence[str], now: float | None = None) -> None:
        at = F.lit(now) if now is not None else F.unix_micros(F.current_timestamp()) / 1e6
        more = {"recordings": recs.withColumn("updated_at", at)}
        if formats:
            more["documents"] = lambda made: self._documents(made("segments"), made("recordings"), formats)
        search.index_commit(self.store, store.indexable(segs), recs.select("rec_id"), more)

    def save(self, segs: DataFrame, recs: DataFrame, formats: Sequence[str] = ()) -> None:
        """Put the recordings in ``recs`` in place of what is kept of them: segments, index, row and documents in one
        version.  Doing it twice changes nothing."""
        self._commit(segs, recs, formats)

    def delete(self, gone: DataFrame) -> None:
        """Recordings go with all that is kept of them."""
        search.index_commit(self.store, None, gone)

    def edit(self, edits: DataFrame) -> dict[str, DataFrame]:
        """Edits (rec_id, seg_id, ordinal, text) carried through everything that depends on the text, and kept: segments,
        search, totals and documents of the recordings change together, or not at all.  Only finished recordings with
        a text that becomes another are touched; their segments and rows are returned."""
        version = self.store.version()
        recs = self.store.read("recordings", version)
        if "status" in recs.columns:
            recs = recs.filter("status = 'concluido'")
        named = self.store.read("segments", version).join(edits.select("rec_id").distinct(), "rec_id", "left_semi").join(recs.select("rec_id"), "rec_id", "left_semi")
        before = named.columns
        merged = store.apply_edits(named.drop("editado"), edits)
        touched = merged.filter("editado").select("rec_id").distinct()
        segs = merged.join(touched, "rec_id", "left_semi")
        if "editado" in before:  # an earlier edit stays marked
            old = named.select("rec_id", "seg_id", F.coalesce("editado", F.lit(False)).alias("__was"))
            segs = segs.join(old, ["rec_id", "seg_id"]).withColumn("editado", F.col("editado") | F.col("__was")).drop("__was")
        if touched.isEmpty():
            return {"segments": segs, "recordings": recs.limit(0)}
        rows = recs.join(touched, "rec_id", "left_semi")
        counted = segs.groupBy("rec_id").agg(F.sum(T.word_count(F.col("text"))).alias("__w"), F.count(F.lit(1)).alias("__n"), F.countDistinct("speaker").alias("__v"))
        rows = rows.join(counted, "rec_id").withColumn("word_count", F.col("__w")).withColumn("editado_em", F.unix_micros(F.current_timestamp()) / 1e6)
        rows = rows.withColumn("detail", L.completion_detail(F.col("__w"), F.col("__n"), F.when(F.col("__v") > 1, F.col("__v")), F.lit(0))).drop("__w", "__n", "__v")
        formats = []
        if version["parts"].get("documents"):
            formats = sorted(r["format"] for r in self.store.read("documents", version).join(touched, "rec_id", "left_semi").select("format").distinct().collect())
        self._commit(segs, rows, formats)
        ids = touched_ids(self.store, version)
        return {name: self.store.read(name).join(ids, "rec_id", "left_semi") for name in ("segments", "recordings")}

    def search(self, query: str, limit: int = 60) -> DataFrame:
        return search.search_index(self.store, query, limit, "recordings")

    def analyze(self, segs: DataFrame) -> dict[str, DataFrame]:
        return analytics.analyze(segs)

    def export(self, segs: DataFrame, only: list[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """Documents by format, and the errors of those that can't be built; errors of running show when one is written."""
        return export.export(self._relations(segs, self.recordings(), [f for f in only or export.BUILDERS if f != "resumo"]), only)

    def write_documents(self, segs: DataFrame, root: str, only: list[str] | None = None) -> tuple[list[str], dict[str, str]]:
        """All documents of the segments' recordings, written by format; formats written and errors by format."""
        return export.write(self._relations(segs, self.recordings(), only), root, only)

    def summary(self) -> DataFrame:
        return analytics.history_summary(self.recordings())


def touched_ids(kept: Snapshots, before: dict) -> DataFrame:
    """The recordings that commits after ``before`` touched."""
    new = [c for c in kept.version()["commits"] if c not in before["commits"]]
    out = kept.written(new[0], "touched")
    for c in new[1:]:
        out = out.unionByName(kept.written(c, "touched"))
    return out.distinct()
