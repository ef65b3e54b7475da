"""Versions of relations and the stored index: every state equals one that is made anew."""

import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, meeting

from jatoba.engine import Engine
from jatoba.operators import search
from jatoba.operators.snapshot import Snapshots
from jatoba.sources import adapters

RECS = "rec_id bigint, filename string, status string, created_at bigint, duration_ms bigint, word_count bigint, avg_confidence double, elapsed_s bigint"


def hits(df):
    return [(r["rec_id"], r["seg_id"], r["start_ms"], r["falante"], r["trecho"], round(r["score"], 6)) for r in df.collect()]


QUERIES = ("contrat Envi", '"até sexta"', "the", "relatorio", "pré-ven", "x", "", '"nada disso"', "the of in")


@pytest.fixture
def segs(spark, sf_dir):
    return adapters.segments(spark, sf_dir).cache()


def test_index_equals_search_over_rows(spark, segs, tmp_path):
    store = search.index_store(spark, str(tmp_path))
    search.index_commit(store, segs, segs.select("rec_id"))
    for q in QUERIES:
        assert hits(search.search_index(store, q)) == hits(search.search(segs, q)), q
    n, size = store.version()["notes"]["index"]
    assert (n, size) == tuple(search.index_sizes(segs).agg(F.sum("n"), F.sum("len")).first())


def test_index_after_edits_and_deletes_equals_a_new_one(spark, segs, tmp_path):
    store = search.index_store(spark, f"{tmp_path}/a")
    search.index_commit(store, segs.filter("rec_id % 3 <> 0"), segs.filter("rec_id % 3 <> 0").select("rec_id"))
    search.index_commit(store, segs.filter("rec_id % 3 = 0"), segs.filter("rec_id % 3 = 0").select("rec_id"))
    changed = segs.filter("rec_id % 5 = 1").withColumn("text", F.concat("text", F.lit(" Enviamos o contrato, contratação.")))
    search.index_commit(store, changed, changed.select("rec_id"))
    search.index_commit(store, None, segs.filter("rec_id % 7 = 2").select("rec_id"))
    now = segs.filter("rec_id % 5 <> 1").unionByName(changed).filter("rec_id % 7 <> 2")
    fresh = search.index_store(spark, f"{tmp_path}/b")
    search.index_commit(fresh, now, now.select("rec_id"))
    want = {q: hits(search.search(now, q)) for q in QUERIES[:3]}
    for q in want:
        assert hits(search.search_index(store, q)) == want[q] == hits(search.search_index(fresh, q)), q
    assert store.version()["notes"] == fresh.version()["notes"]
    store.compact()
    store.vacuum()
    assert len(store.folder.names("parts")) == 1 and len(store.folder.names("versions")) == 1
    for q in want:
        assert hits(search.search_index(store, q)) == want[q], q
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(store.read("postings")) == rows(search.posting_lists(now))


def test_only_files_with_the_tokens_are_opened(spark, segs, tmp_path):
    store = search.index_store(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        search.index_commit(store, segs, segs.select("rec_id"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = len(store.read("postings").inputFiles())
    found = search.pruned(store, search.parse("contrat"))
    assert files >= 4 and len(found.inputFiles()) == 1
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(token,contrat)" in plan
    assert found.count() == store.read("postings").filter("startswith(token, 'contrat')").count() > 0


def test_a_hot_token_fills_several_files(spark, tmp_path):
    rows = [(i, 1, None, 0, 10, f"zero palavra{i}", 0.9, []) for i in range(400)]
    store = search.index_store(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        search.index_commit(store, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(r[0],) for r in rows], "rec_id bigint"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    (part,) = store.version()["parts"]["postings"]
    assert sum(low <= "zero" <= high for _, low, high, _ in store._part(part, "postings")["files"]) >= 2


def engine(spark, root):
    e = Engine(spark, str(root))
    a = meeting(spark, ["O contrato será assinado.", "Até sexta, então.", "Fim de conversa"], ["A", "B", "A"])
    b = a.withColumn("rec_id", F.lit(2).cast("bigint"))
    recs = spark.createDataFrame([(1, "a.wav", "concluido", 5, 600_000, 10, 0.9, 42), (2, "b.wav", "erro", 6, 600_000, 10, 0.9, 42)], RECS)
    e.save(a.unionByName(b), recs, ["txt_timestamps", "tsv", "srt"])
    return e


def state(e):
    docs = {(r["rec_id"], r["format"]): bytes(r["content"]).decode() for r in e.documents().collect()}
    words = {r["rec_id"]: r["word_count"] for r in e.recordings().collect()}
    found = {q: [(r["rec_id"], r["seg_id"], r["arquivo"]) for r in e.search(q).collect()] for q in ("contrat", "acordo", '"até sexta"')}
    return docs, words, found, sorted((r["rec_id"], r["seg_id"], r["text"]) for r in e.segments().select("rec_id", "seg_id", "text").collect())


EDITS = [(1, 1, 0, "O acordo ,será bem assinado."), (1, 2, 0, "  "), (2, 1, 0, "O acordo de outro.")]


def edits(spark):
    return spark.createDataFrame(EDITS, "rec_id bigint, seg_id bigint, ordinal int, text string")


def test_edits_last_in_search_documents_and_totals(spark, tmp_path):
    e = engine(spark, tmp_path)
    docs, words, _, _ = state(e)
    out = e.edit(edits(spark))
    assert {r["rec_id"] for r in out["segments"].collect()} == {1}  # the other recording failed, so it can't be edited
    after = state(Engine(spark, str(tmp_path)))
    assert after[2] == {"contrat": [(2, 1, "b.wav")], "acordo": [(1, 1, "a.wav")], '"até sexta"': [(1, 2, "a.wav"), (2, 2, "b.wav")]}
    assert after[1][1] == sum(len(t.split()) for r, _, t in after[3] if r == 1) and after[1][2] == words[2]
    assert all("O acordo, será bem assinado." in after[0][1, f] for f in ("txt_timestamps", "tsv")) and "acordo" in after[0][1, "srt"]
    assert {k: v for k, v in after[0].items() if k[0] == 2} == {k: v for k, v in docs.items() if k[0] == 2}
    row = e.recordings().filter("rec_id = 1").first()
    assert row["editado_em"] > 0 and row["detail"].startswith(f"{after[1][1]} palavras em 3 trechos")
    again = e.store.version()["number"]
    e.edit(edits(spark))  # nothing differs any more
    assert e.store.version()["number"] == again and state(e) == after
    second = e.edit(spark.createDataFrame([(1, 3, 0, "Fim.")], "rec_id bigint, seg_id bigint, ordinal int, text string"))["segments"].collect()
    assert sorted((r["seg_id"], r["editado"]) for r in second) == [(1, True), (2, False), (3, True)]


def test_a_failure_between_parts_leaves_the_old_state(spark, tmp_path, monkeypatch):
    e = engine(spark, tmp_path)
    before = state(e)
    write, path = Snapshots._write, Snapshots._path

    def full(*_):
        raise OSError("the store is full")

    def failing(part):
        def f(self, commit, relation, rows):
            write(self, commit, relation, rows)
            if relation == part:
                full()

        return f

    for part in ("touched", "segments", "postings", "recordings", "documents", "publish"):
        if part == "touched":
            monkeypatch.setattr(Snapshots, "_path", lambda self, c, r: "/proc/nowhere" if r == "touched" else path(self, c, r))
        elif part == "publish":
            monkeypatch.setattr(Snapshots, "_publish", full)
        else:
            monkeypatch.setattr(Snapshots, "_write", failing(part))
        with pytest.raises(Exception):  # noqa: B017
            e.edit(edits(spark))
        monkeypatch.undo()
        assert e.store.version()["number"] == 1, part
    assert state(Engine(spark, str(tmp_path))) == before
    e.edit(edits(spark))
    e.store.vacuum()
    used = {p for ps in e.store.version()["parts"].values() for p in ps} | set(e.store.version()["commits"])
    assert set(e.store.folder.names("parts")) == used and state(e) != before


def test_a_reader_keeps_its_version_and_writers_do_not_mix(spark, tmp_path):
    e = engine(spark, tmp_path)
    old = e.store.version()
    e.delete(spark.createDataFrame([(1,)], "rec_id bigint"))
    assert {r["rec_id"] for r in e.segments().collect()} == {2} and e.search("contrat").count() == 1
    assert {r["rec_id"] for r in e.store.read("segments", old).collect()} == {1, 2}
    with pytest.raises(FileExistsError):
        e.store._publish({**old, "number": old["number"] + 1})
