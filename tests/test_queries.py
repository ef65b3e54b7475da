import duckdb
import pytest

import __spark_entry__ as entry

OWN = [n for n in entry.queries() if not n.startswith("op") or n.startswith("orders")]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in OWN if n != "pipeline"])
def test_query_has_rows(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    rows = df.limit(5).collect()
    assert rows or name in ("retention_delete", "chapters"), name
    assert len(set(df.columns)) == len(df.columns)


def test_oracles_parse():
    con = duckdb.connect()
    assert all(con.extract_statements(sql) for sql in entry.oracle_sql().values())


def same_as_sql(spark, sf_dir, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)
    return con, got


def test_confidence_of_all_rows(spark):
    con, got = same_as_sql(spark, "/root/testdata/sf0.01", "raw_confidence", "lineitem")
    assert len(got) == con.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    assert max(r[0] for r in got) > 5000


def test_whole_texts_are_wrapped(spark):
    _, got = same_as_sql(spark, "/root/testdata/sf0.01", "wrap_balanced", "conversations")
    assert max(len(r[2]) for r in got) > 71


def test_formats_of_all_recordings(spark):
    con, got = same_as_sql(spark, "/root/testdata/sf0.01", "formats", "conversations")
    assert len(got) == 13 * con.execute("SELECT count(DISTINCT conv_id) FROM conversations").fetchone()[0]
    assert (3, "pdf", "PDF", "gravacao_3_transcricao.pdf") in {r[:4] for r in got}
