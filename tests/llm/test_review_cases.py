"""Cases of the last review: measures without gaps, models of rare languages, links of large files."""

import numpy as np
import pytest


DATA = [
    "{1.0f, 2.5f, 3.5f, 4.0f, 5.5f}", "{10u, 20u, 30u, 40u, 50u}", "0xaf, 0xbe, 0xcd, 0xff, 0xaa,", "0XAFuL ,-1.5 , 2F,\n-3l,4",
    '{"a": 1}\n{"a": 2}\n{"a": 3}', '"' + r"\x1f\x8b" * 8 + '"', "1,2,3,4,5", '[{"a": 1}, {"b": 2}]', "'" + "Ab9+" * 10 + "'",
]


@pytest.mark.parametrize("text", DATA)
def test_data_measure_has_no_gap(text):
    from tesserine.llm import generated_files as G

    m = G._DATA.search(text)
    measured = G.measure([text, "no data"], ["c", "c"], [1, 1], {G.OTHER: G.Model(np.ones(G.CELLS), np.zeros(G.STYLES + 2 * G._SIZES))})
    assert m and measured["data_chars"] == [sum(len(x[0]) for x in G._DATA.finditer(text)), 0]


def test_rare_languages_share_their_own_model(spark, monkeypatch):
    from tesserine.llm import generated_files as G

    monkeypatch.setattr(G, "MAX_LANGUAGES", 1)
    rows = [("a", "abc abd"), ("a", "abc"), ("b", "qzx qzx"), ("c", "qzy"), (G.OTHER, "qzz")]
    models = G.train(spark.createDataFrame(rows, "lang string, text string").coalesce(1))
    assert set(models) == {"a", G.OTHER}
    same = G.train(spark.createDataFrame([("x", "qzx qzx"), ("x", "qzy"), ("x", "qzz")], "lang string, text string").coalesce(1))["x"]
    assert np.array_equal(models[G.OTHER].bits, same.bits) and np.array_equal(models[G.OTHER].style, same.style)


def test_large_files_lose_no_link(spark):
    from tesserine.llm import similar_vectors as V

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, 6, rng.normal(size=6).tolist()) for i in range(400)], "id long, dims int, vector array<float>")
    whole, parted = ({(r.id, r.other, r["rank"]) for r in V.similar_vectors(df, cell=c, pivot_bytes=288, rerank=400).collect()} for c in (1000, 40))
    assert whole == parted


def test_stored_trigrams_give_the_same_secrets(spark, sf, tmp_path):
    from tesserine.llm import secrets as S
    from tesserine.llm import trigrams as T

    texts = spark.read.parquet(f"{sf}/chunks.parquet").select("id", "text").dropDuplicates(["id"]).repartition(3)
    folder = f"file://{tmp_path}/index"
    T.store_index(texts, folder)
    plain = {tuple(r) for r in S.find_secrets(texts).collect()}
    assert {tuple(r) for r in S.find_secrets_indexed(texts, folder).collect()} == plain and plain
    # Any query over the stored index is a test of containment.
    rows = texts.collect()
    queries = {"and": ("and", ("ret", "urn")), "or": ("or", ("xyz", "qua")), "one": "def"}
    got = {(r["id"], k) for r in T.candidates(spark, folder, queries).collect() for k in r["names"]}
    low = {r["id"]: (r["text"] or "").lower() for r in rows}
    assert got == {(i, "and") for i, t in low.items() if "ret" in t and "urn" in t} | {(i, "or") for i, t in low.items() if "xyz" in t or "qua" in t} | {(i, "one") for i, t in low.items() if "def" in t}
    T.store_index(texts.limit(0), f"file://{tmp_path}/none")


def test_cutoffs_count_every_labelled_row(spark):
    """The holdout is no sample: a rare stratum among very many rows is certified by all the labels it has."""
    from tesserine.llm import repetition as R

    rows = spark.range(60_000).selectExpr(
        "id as key", "if(id % 120 = 0, 'rare', 'common') as stratum", "case when id % 3 = 0 then 0.04 when id % 400 = 1 then 0.5 else 0.2 end as score",
        "case when id % 1000 = 7 then true when id % 1000 < 990 then false end as label").cache()
    report = {r["stratum"]: r for r in R.cutoff_report(rows).collect()}
    held = rows.where("label is not null").toPandas()
    assert set(report) == {"common", "rare"}
    for s, r in report.items():
        clean, marked = (held[(held.stratum == s) & (held.label == x)] for x in (False, True))
        assert r["clean"] == len(clean) and r["certified"]
        assert r["rejected"] == (clean.score >= r["cutoff"]).sum() and r["missed"] == (marked.score < r["cutoff"]).sum()
        assert r["risk_bound"] == R.risk_bound(r["rejected"], r["clean"], 0.05 / 2)


def test_every_stratum_has_a_row_however_many(spark):
    from tesserine.llm import repetition as R

    rows = spark.range(42_000).selectExpr("id as key", "if(id < 2000, 'en', 'x' || id) as stratum", "0.1 as score", "false as label")
    report = R.cutoff_report(rows)
    assert report.count() == 40_001 and [r["stratum"] for r in report.where("certified").collect()] == ["en"]
    flagged = R.repetitive_documents(spark.createDataFrame([("en", 0.2), ("x3000", 0.2), ("x3000", 0.99)], "stratum string, score double"), report)
    assert {(r["stratum"], r["score"], r["certified"]) for r in flagged.collect()} == {("en", 0.2, True), ("x3000", 0.99, False)}


def test_binomial_tail_of_many_documents():
    from fractions import Fraction
    from math import comb

    from tesserine.llm import repetition as R

    for n, k in ((3000, 0), (3000, 20), (3000, 29), (3000, 30), (3000, 31), (3000, 60), (3000, 2999)):
        exact = sum(comb(n, i) * 99 ** (n - i) for i in range(k + 1)) / Fraction(100**n)
        assert R.binomial_tail(k, n, 0.01) == pytest.approx(float(exact), rel=1e-10)
    for k in (10**6, 10**9):  # as many chances below the middle as above it
        assert R.binomial_tail(k, 2 * k + 1, 0.5) == pytest.approx(0.5, rel=1e-9)
    bound = R.risk_bound(10**7, 10**9, 0.05)
    assert 0.01 < bound < 0.01001 and R.binomial_tail(10**7, 10**9, bound) == pytest.approx(0.05, rel=1e-4)
