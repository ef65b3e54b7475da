"""String kernels against sets, and languages on held-out rows."""

import zlib

import numpy as np

from jatoba.llm import language

TEXTS = ["Ab, c!", None, "", "...", "1234 5", "É", "aa aa aa", "Straße 12b", "x" * 5000 + " y", "ΑΒ γδ", "a\n\nb", "\U00010400 ok", " lead", "trail "]


def plain_runs(text):
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    if not low.strip():
        return set()
    padded = " " + " ".join(low.split()) + " "
    return {padded[i : i + k] for k in range(1, language.ORDER + 1) for i in range(len(padded) - k + 1)}


def unpacked(run):
    out = ""
    while run:
        out, run = chr(run & 0x1FFFFF) + out, run >> 21
    return out


def test_runs_are_those_of_the_text():
    for t in TEXTS:
        found = language.runs(t)
        assert {unpacked(int(r)) for r in found} == plain_runs(t), t
        assert (np.diff(found.astype(object)) > 0).all()


def test_kernel_is_the_shared_part():
    marks = ["Ab c d", "straße", "aa", "ok lead"]
    sets = [language.runs(t) for t in marks]
    known = np.unique(np.concatenate(sets))
    there = np.array([[k in s for s in sets] for k in known])
    model = language.Model(["x"], known, np.packbits(there, axis=1), np.array([len(s) for s in sets], float), np.zeros((4, 1), np.float32))
    got = model.kernel(TEXTS)
    for t, row in zip(TEXTS, got, strict=True):
        a = plain_runs(t)
        want = [len(a & plain_runs(m)) / max(1, len(a)) ** 0.5 / len(plain_runs(m)) ** 0.5 for m in marks]
        assert np.allclose(row, want, atol=1e-6), t


def aside(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = language.query(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = got.collect()
    assert len(rows) == len(want) and all(r["held_out"] == aside(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in unseen) >= 0.99 * len(unseen)


def odd(spark, langs=("fr", "de")):
    words = {"fr": "le chat noir dans la maison avec une autre", "de": "der hund und das haus mit einem anderen"}
    rows = [(i, f"{words[langs[i % len(langs)]]} {i}", langs[i % len(langs)], "q") for i in range(80)]
    rows += [(200, None, "fr", "q"), (201, "", "fr", "q"), (202, "12 !?", "xx", "q"), (None, "le chat", "fr", "q"), (203, "das haus", None, "q"), (204, "der hund " * 30_000, "de", "q"), (3, rows[3][1], rows[3][2], "q"), (3, rows[3][1], rows[3][2], "q")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, SCORE string")


def test_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = language.query(spark, str(tmp_path)).collect()
    assert len(rows) == 88
    by = {r["doc_id"]: r for r in rows}
    assert [(by[d]["lang_pred"], by[d]["score"]) for d in (200, 201, 202)] == [("und", 0.0)] * 3
    assert (by[None]["lang_pred"], by[203]["lang_pred"], by[204]["lang_pred"]) == ("fr", "de", "de")
    assert len({r["score"] for r in rows if r["doc_id"] == 3}) == 1


def test_held_out_labels_teach_nothing(spark):
    docs = odd(spark)
    from pyspark.sql import functions as F

    from jatoba.llm.toxicity import held_out

    out = held_out(F.col("doc_id"), 4, 2)
    other = docs.withColumn("lang", F.when(out, "zz").otherwise(F.col("lang")))
    a, b = (sorted(map(str, language.predict(x, language.train(x.filter(~out))).collect())) for x in (docs, other))
    assert a == b


def test_few_languages_or_none(spark):
    one = odd(spark, ("fr",))
    one = one.filter("lang = 'fr'")
    assert {(r["lang_pred"], r["score"]) for r in language.predict(one.filter("doc_id < 100"), language.train(one)).collect()} == {("fr", 1.0)}
    none = one.limit(0)
    assert language.train(none) is None
    assert {(r["lang_pred"], r["score"]) for r in language.predict(one, None).collect()} == {("und", 0.0)}
    assert language.predict(none, language.train(one)).count() == 0
    # more languages than landmarks: each keeps one
    many = spark.createDataFrame([(i, f"{chr(97 + i % 20) * 3} {chr(98 + i % 20) * 4}", f"l{i % 20:02d}") for i in range(200)], "doc_id bigint, text string, lang string")
    model = language.train(many, landmarks=10, sample=150)
    assert len(model.names) == 20 and len(model.sizes) >= 20
    got = language.predict(many, model).join(many, "doc_id").filter("lang_pred = lang").count()
    assert got >= 190
