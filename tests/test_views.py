import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jatoba.functions import labels as L
from jatoba.operators import view
from jatoba.sources import media

NAMES = (
    "search_like_recordings", "visible_segments", "neighbours", "live_fields", "figure_labels", "vocabulary_terms", "completion_detail", "thinned_points", "stage_steps", "merge_polled", "raw_totals", "removed_jobs",
    "paced_ahead",
)


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("conversations", "orders", "part", "events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ran = con.execute(entry.oracle_sql()[name])
    cols = sorted(c[0] for c in ran.description)
    want = [dict(zip([c[0] for c in ran.description], r, strict=True)) for r in ran.fetchall()]
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == cols
    rows = lambda found: sorted(repr([r[c] for c in cols]) for r in found)
    got = [r.asDict() for r in df.collect()]
    assert got and rows(got) == rows(want)


def test_labels_of_odd_values(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 0L, -1D), (2, NULL, double('nan')), (3, 1023L, 59.9D), (4, 1024L, 3599.9D), (5, 1280L, 3600D), (6, 1099511627776L * 5000, double('infinity')), (7, 1L, NULL) t(i, b, s)")
    got = [tuple(r) for r in df.orderBy("i").select(L.bytes_label(F.col("b")), L.clock(F.col("s"))).collect()]
    assert got == [("0 B", "00:00"), ("0 B", "00:00"), ("1023 B", "00:59"), ("1.0 KB", "59:59"), ("1.3 KB", "1:00:00"), ("5000.0 TB", "00:00"), ("1 B", "00:00")]


def test_identifiers(spark):
    good = "0f8fad5b-d9cb-469f-a165-70867728950e"
    df = spark.createDataFrame([(good,), ("../" + good,), (good + "\n",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(L.is_job_id(F.col("x"))).collect()] == [True, False, False, False, False]


def test_visible_keeps_segments_without_a_speaker(spark):
    df = spark.createDataFrame([(1, "a", "Até já", 0.9), (2, None, "ATÉ", 0.1), (3, "b", None, 0.1), (4, "", "ate", 0.2), (5, "a", "até", None)], "seg_id int, speaker string, text string, confidence double")
    ids = lambda d: sorted(r.seg_id for r in d.collect())
    assert ids(view.visible(df, "Até")) == [1, 2, 5]
    assert ids(view.visible(df, hidden=["a"])) == [2, 3, 4]
    assert ids(view.visible(df, low_only=True)) == [2, 3, 4]


def test_model_flags_and_written_jobs(spark, tmp_path):
    models = spark.createDataFrame([("large",), ("small",)], "nome string")
    rows = {r.nome: (r.baixado, r.padrao) for r in view.model_flags(models, models.filter("nome = 'small'").union(models.filter("nome = 'small'")), "large").collect()}
    assert rows == {"large": (False, True), "small": (True, False)}
    view.write_jobs(models.withColumn("result", F.lit("x")).withColumn("live_segments", F.array(F.lit(1))), str(tmp_path / "jobs"))
    lines = [json.loads(x) for f in (tmp_path / "jobs").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(lines, key=str) == [{"nome": "large"}, {"nome": "small"}]


def test_settings_of_a_file_give_way_to_the_environment():
    env = media.dotenv("# x=1\nA = 'one'\nA=two\nB=2,5\nnothing\nC=\n=z\n", {"B": "3"})
    assert env == {"A": "one", "B": "3", "C": ""}
    assert media.setting("B", 1.0, env) == 3.0
