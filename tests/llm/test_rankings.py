"""Rank fusion and similar vectors."""

import datetime as dt
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tesserine.llm import rank_fusion as R
from tesserine.llm import similar_vectors as V
from tesserine.operators.ordered import ordered, with_rank, with_running_sum

T0 = dt.datetime(2026, 1, 1)
SCORED = "query_id long, chunk_rowid long, arm string, score double, tier int, scored_at timestamp_ntz, rank string"


def random_scores(seed, queries=12, most=30):
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(queries):
        for c in range(int(rng.integers(1, most))):
            tier = int(rng.integers(0, 4)) if rng.random() < 0.8 else None
            for arm in R.ARMS:
                if rng.random() < 0.8:
                    s = [float(rng.integers(0, 5)), None, float("nan"), float("inf")][int(rng.choice(4, p=[0.85, 0.06, 0.06, 0.03]))]
                    rows.append((q, c, arm, s, tier, T0 + dt.timedelta(int(rng.integers(0, 3))), "x"))
    return rows + rows[:5]


def brute_winners(rows):
    latest = {}
    for q, c, arm, s, tier, at, _ in rows:
        latest[q, c, arm] = max(latest.get((q, c, arm), (at, s is not None, s if s == s else s)), (at, s is not None, s), key=lambda x: (x[0], x[1], x[2] is not None and (x[2] != x[2]), x[2] if x[2] is not None and x[2] == x[2] else 0))
    cand = defaultdict(lambda: defaultdict(dict))
    for q, c, arm, s, tier, at, _ in rows:
        cand[q][c].setdefault("tier", None)
        if tier is not None:
            cand[q][c]["tier"] = max(tier, cand[q][c]["tier"] if cand[q][c]["tier"] is not None else tier)
    for (q, c, arm), (_, _, s) in latest.items():
        if s is not None and s == s:
            cand[q][c][arm] = s * R.ARMS[arm]
    out = set()
    for q, cs in cand.items():
        for c, v in cs.items():
            if all(sum(np.sign(v[k] - u[k]) if v[k] != u[k] else 0 for k in v if v[k] is not None and u.get(k) is not None) > 0 for d, u in cs.items() if d != c):
                out.add((q, c))
    return out


def test_winners(spark):
    for seed in range(3):
        rows = random_scores(seed)
        assert {tuple(r) for r in R.winners(spark.createDataFrame(rows, SCORED)).collect()} == brute_winners(rows)


def test_medians_are_exact(spark, monkeypatch):
    """Also where the sketch is far too coarse to know them."""
    rng = np.random.default_rng(6)
    rows = [(q, i, float(v) if rng.random() < 0.9 else None, float(rng.integers(0, 3))) for q, n in ((1, 3000), (2, 1), (3, 40), (4, 41)) for i, v in enumerate(rng.normal(size=n))]
    rows += [(5, 1, None, 2.0), (5, 2, None, float("inf"))]
    for accuracy in (10_000, 20):
        monkeypatch.setattr(R, "ACCURACY", accuracy)
        df = spark.createDataFrame(rows, "query_id long, chunk_rowid long, x double, y double").withColumn("_salt", (F.col("chunk_rowid") % R.SALTS).cast("int"))
        got = {r["query_id"]: (r["x"], r["y"]) for r in R.exact_medians(df, {"x": F.col("x"), "y": F.col("y")}).collect()}
        for q in range(1, 6):
            for k in (0, 1):
                v = sorted(r[2 + k] for r in rows if r[0] == q and r[2 + k] is not None)
                assert got[q][k] == (v[(len(v) + 1) // 2 - 1] if v else None)


def test_planted_order(spark):
    """Candidates of a known quality, seen through four scores on unlike scales, come out in the order of it."""
    rng = np.random.default_rng(7)
    rows = []
    for c in range(60):
        q = c / 60
        for arm, s in (("lexical", -1e-6 * (1 + q)), ("vector", 0.5 + 0.4 * q), ("anchor", 10.0 ** (9 * q)), ("usage", float(int(50 * q)))):
            rows.append((1, c, arm, s * (1 + 1e-3 * rng.normal()) if arm != "usage" else s, 1, T0, "x"))
    rank = {r["chunk_rowid"]: r["rank"] for r in R.ranking(spark.createDataFrame(rows, SCORED)).collect()}
    places = np.array([rank[c] for c in range(60)])
    assert np.corrcoef(places, np.arange(60))[0, 1] < -0.99
    # A candidate far out on one score does not rise above the rest by it.
    rows += [(1, 100, "anchor", 1e30, 1, T0, "x"), (1, 100, "vector", 0.51, 1, T0, "x"), (1, 100, "usage", 0.0, 1, T0, "x"), (1, 100, "lexical", -1e-6, 1, T0, "x")]
    assert {r["chunk_rowid"]: r["rank"] for r in R.ranking(spark.createDataFrame(rows, SCORED)).collect()}[100] > 20


def test_no_score_rules_by_its_range(spark):
    """A candidate that is far out on one score only does not beat one that is good on all."""
    rows = []
    for c in range(20):
        for arm, s in (("lexical", -float(c)), ("vector", c / 20), ("anchor", float(c % 5)), ("usage", float(c))):
            rows.append((1, c, arm, s, 1, T0, "x"))
    rows += [(1, 99, "usage", 1e12, 1, T0, "x"), (1, 98, "other", 5.0, None, T0, "x"), (1, None, "usage", 1.0, 1, T0, "x"), (None, 1, "usage", 1.0, 1, T0, "x")]
    got = {r["chunk_rowid"]: r for r in R.ranking(spark.createDataFrame(rows, SCORED)).collect()}
    assert got[19]["rank"] == 1 and got[98]["rank"] == len(got) and got[98]["fused"] is None
    assert sorted(r["rank"] for r in got.values()) == list(range(1, len(got) + 1))
    assert all(0 < r["fused"] < 1 for c, r in got.items() if c != 98)


def test_ties_and_empty(spark):
    rows = [(1, c, "usage", 3.0, None, T0, "x") for c in (5, 2, 9)]
    got = [(r["chunk_rowid"], r["rank"], r["fused"]) for r in R.ranking(spark.createDataFrame(rows, SCORED)).orderBy("rank").collect()]
    assert got == [(2, 1, 0.5), (5, 2, 0.5), (9, 3, 0.5)]
    empty = R.ranking(spark.createDataFrame([], SCORED))
    assert empty.count() == 0 and R.winners(spark.createDataFrame([], SCORED)).count() == 0


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    rows = with_running_sum(with_rank(ordered(df, ["g"], [F.col("v")]), ["g"]), ["g"], "v", "total").collect()
    for g in range(3):
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: r["v"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["total"] for r in mine] == np.cumsum([r["v"] for r in mine]).tolist()


VECTORS = "id long, dims int, vector array<float>, rank int"


def exact(rows, k):
    """The k nearest by cosine per id, ties at the k-th place included."""
    good = {}
    for i, d, v, _ in rows:
        if i is not None and v is not None and len(v) == d and d and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    out = {}
    for i, v in good.items():
        sims = sorted((-round(float(v @ u), 6), j) for j, u in good.items() if j != i and len(u) == len(v))
        out[i] = {j for s, j in sims if sims and s <= sims[min(k, len(sims)) - 1][0]}
    return out


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    rows = [(i, 24, (centres[i % 40] + rng.normal(size=24) * 0.4).tolist(), 0) for i in range(1500)]
    got = defaultdict(set)
    for r in V.similar_vectors(spark.createDataFrame(rows, VECTORS)).collect():
        got[r["id"]].add(r["other"])
    truth = exact(rows, 5)
    assert all(len(got[i]) == 5 for i in truth)
    assert sum(len(got[i] & truth[i]) for i in truth) / (5 * len(truth)) >= 0.9


def test_dirty_vectors_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 8, rng.normal(size=8).tolist(), 0) for i in range(40)]
    rows += [(100 + i, 8, rows[0][2], 0) for i in range(12)] + [rows[3], rows[3]]
    rows += [(200, 8, None, 0), (201, 8, [0.0] * 8, 0), (202, 8, [float("nan")] + [1.0] * 7, 0), (203, 8, [float("inf")] + [1.0] * 7, 0), (204, 9, [1.0] * 8, 0), (205, 8, [None] + [1.0] * 7, 0), (None, 8, [1.0] * 8, 0)]
    rows += [(300, 3, [1e-30, 0.0, 0.0], 0), (301, 3, [1e30, 1e30, 0.0], 0)]
    got = defaultdict(dict)
    for r in V.similar_vectors(spark.createDataFrame(rows, VECTORS), prefix=8).collect():
        got[r["id"]][r["rank"]] = r["other"]
    assert not {200, 201, 202, 203, 204, 205} & set(got) and got[300] == {1: 301} and got[301] == {1: 300}
    copies = [0, *range(100, 112)]
    for i in copies:
        assert list(got[i].values()) == [c for c in copies if c != i][:5]
    assert all(sorted(got[i]) == [1, 2, 3, 4, 5] for i in range(40))
    assert V.similar_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def recall(spark, rows, **how):
    truth, got = exact(rows, 5), defaultdict(set)
    for r in V.similar_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), **how).collect():
        got[r["id"]].add(r["other"])
    return sum(len(got[i] & truth[i]) for i in truth) / (5 * len(truth))


def test_recall_of_divided_files_and_few_pivots(spark):
    """With the shipped settings of prefix and rerank, where the bound on pivots binds, files are parted and rooms cut."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows = [(i, 16, (centres[i % 30] + rng.normal(size=16) * 0.5).tolist(), 0) for i in range(1200)]
    assert recall(spark, rows, pivot_bytes=40 * 16 * 4, cell=60) >= 0.9  # 40 pivots; files of 180 vectors in six blocks
    assert recall(spark, rows, pivot_bytes=40 * 16 * 4) >= 0.9
    assert recall(spark, rows, room=50) >= 0.9
    assert recall(spark, rows, pivot_bytes=0, cell=200) >= 0.9  # as few pivots as a permutation has places
    assert recall(spark, [(i, 6, rng.normal(size=6).tolist(), 0) for i in range(400)], pivot_bytes=288, cell=40) >= 0.9


def test_a_vector_travels_once_to_a_room():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(50, 16))
    points = (centres[rng.integers(0, 50, 3000)] + rng.normal(size=(3000, 16)) * 0.4).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    pivots = V.Pivots(points[:400], 1)
    perm = pivots.permutations(points, 6)
    near = np.argsort(-(points @ pivots.vectors.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(perm, near)]) >= 0.95
    counts = np.bincount(perm.ravel(), minlength=400)
    room = V._rooms(pivots, counts, 1000, 1)
    assert np.mean([len(set(r)) for r in room[perm]]) < 3 and np.bincount(room, counts).max() <= 4000
    assert set(V._rooms(pivots, counts, 1 << 30, 1)) == {0}
    assert np.bincount(V._rooms(pivots, np.ones(400, int), 1, 1)).max() <= 4


def test_footrule():
    rng = np.random.default_rng(4)
    a, b = (np.array([rng.permutation(9)[:4] for _ in range(6)], np.int32) for _ in range(2))
    for x, row in zip(a, V._footrule(a, b)):
        for y, close in zip(b, row):
            place = lambda p, v: list(p).index(v) if v in p else 4
            distance = sum(abs(place(x, v) - place(y, v)) for v in range(9))
            assert distance == 2 * sum(range(1, 5)) - 2 * close
