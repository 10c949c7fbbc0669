"""Near duplicates against all pairs."""

import itertools
import random
import re
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserine.llm import near_duplicates as N
from tesserine.llm.words import hash_words, pieces


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def brute(rows, n, threshold, least):
    t = Fraction(threshold)
    sets = {}
    for i, text in rows:
        w = words(text)
        s = frozenset(zip(*(w[k:] for k in range(n))))
        if i is not None and len(w) >= least and s:
            sets.setdefault(i, set()).add(s)
    out = set()
    for a in sets:
        for b in sets:
            if a < b and any(len(x & y) * t.denominator >= len(x | y) * t.numerator for x in sets[a] for y in sets[b]):
                out.add((a, b))
    return out


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = words(rng.choice(rows)[1])
            for _ in range(rng.randrange(4)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base.insert(rng.randrange(len(base)), "new")
        else:
            base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))]
        rows.append((i, " ".join(base)))
    return rows


def found(df):
    return {(r["id_a"], r["id_b"]) for r in df.collect()}


def test_all_pairs(spark):
    rows = corpus() + [(200, None), (201, ""), (202, "a b"), (None, "x y z"), (0, corpus()[0][1]), (203, "Größe É x²_y " * 9), (204, "größe é X²_y " * 9)]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "id long, text string, size int, set_key string")
    for n, t, least in ((3, "0.6", 20), (5, "0.8", 1), (2, "1", 1)):
        assert found(N.near_duplicate_pairs(df, n, t, least)) == brute(rows, n, t, least)


def test_hot_copies_and_long_text(spark):
    base = " ".join(f"t{i}" for i in range(40))
    long = " ".join(f"l{i % 5000}" for i in range(60_000))
    rows = [(i, base) for i in range(30)] + [(100, base + " tail"), (101, long), (102, long + " end"), (103, "other words entirely here")]
    df = spark.createDataFrame(rows, "id long, text string")
    out = {r["id"]: r for r in N.near_duplicate_classes(df, 3, "0.6", 3).collect()}
    assert {r["class_id"] for i, r in out.items() if i <= 100} == {0} and out[0]["copies"] == 30 and out[0]["links"] == 1
    assert out[101]["class_id"] == out[102]["class_id"] == 101 and out[103]["class_id"] == 103 and out[103]["links"] == 0


def test_classes_are_components(spark):
    rows = corpus(3)
    pairs = brute(rows, 3, "0.6", 3)
    parent = {i: i for i, t in rows if len(words(t)) >= 3}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(pairs):
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["class_id"] for r in N.near_duplicate_classes(spark.createDataFrame(rows, "id long, text string"), 3, "0.6", 3).collect()}
    assert got == {i: root(i) for i in parent}


def test_empty(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert N.near_duplicate_pairs(empty).count() == 0 and N.near_duplicate_classes(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 40)), min_size=1, max_size=8), st.integers(1, 30))
def test_allocation_is_optimal(parts, units):
    sizes, costs = np.array([p[0] for p in parts]), np.array([float(p[1]) for p in parts])
    chosen = N.allocate(sizes, costs, units)
    covers = [m for m in itertools.product([False, True], repeat=len(parts)) if sizes[list(m)].sum() >= units]
    if covers:
        assert sizes[chosen].sum() >= units and costs[chosen].sum() == min(costs[list(m)].sum() for m in covers)
    else:
        assert chosen.all()


def test_allocation_of_many_units_covers_them():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes, costs = rng.integers(1, 200, 500), rng.random(500)
        for units in (300, 5_000, int(sizes.sum()) - 1):
            chosen = N.allocate(sizes, costs, units)
            assert sizes[chosen].sum() >= units
            greedy = np.argsort(costs / sizes)
            greedy = greedy[: np.searchsorted(np.cumsum(sizes[greedy]), units) + 1]
            assert costs[chosen].sum() <= costs[greedy].sum() + 1e-9


def test_size_classes():
    for t in (Fraction(3, 5), Fraction(4, 5), Fraction(1, 2)):
        bounds = N.size_bounds(t, 5000)
        for x in range(1, 3000):
            last = x * t.denominator // t.numerator
            assert np.searchsorted(bounds, last, "right") - np.searchsorted(bounds, x, "right") <= 1


def shared_phrases(n=400):
    """Texts of which each has most of its words from phrases that hundreds of others hold too."""
    rng = random.Random(4)
    phrases = [[f"p{i}w{j}" for j in range(12)] for i in range(12)]
    rows = [(i, " ".join(w for p in rng.sample(phrases, 5) for w in p) + f" own{i} tail{i} end{i} last{i} stop{i}") for i in range(n)]
    return rows + [(n + i, rows[i][1].replace("w3", "x3", 1)) for i in range(20)]


def test_candidates_stay_few_whatever_the_blocks_and_ranges(spark, monkeypatch):
    rows = shared_phrases()
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    t = Fraction(9, 10)
    truth = brute(rows, 3, t, 1)
    plain = N.candidate_pairs(df, 3, t, 1).count()
    assert found(N.near_duplicate_pairs(df, 3, t, 1)) == truth and len(truth) >= 20
    monkeypatch.setattr(N, "_RANGE_BITS", 1 << 9)  # far more bits than a range should hold
    assert N.candidate_pairs(df, 3, t, 1).count() == plain <= 4 * len(truth)
    # Without the allocation, every shared partition would be probed.
    monkeypatch.setattr(N, "choose_probes", lambda o, v, s, n, *_: (np.ones(len(o), bool), np.ones(len(o), bool)))
    assert N.candidate_pairs(df, 3, t, 1).count() > 10 * plain


def test_common_bits_travel_once_a_block(spark, monkeypatch):
    rng = random.Random(8)
    head = " ".join(f"licence{i}" for i in range(30))
    rows = [(i, f"{head} " + " ".join(f"b{rng.randrange(400)}" for _ in range(12))) for i in range(300)] + [(1000 + i, " ".join(f"c{rng.randrange(900)}" for _ in range(30))) for i in range(100)]
    rows += [(2000 + i, rows[i][1] + " tail") for i in range(15)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)
    truth = brute(rows, 3, "0.8", 1)
    links = N.candidate_pairs(df, 3, Fraction("0.8"), 1).collect()
    assert found(N.near_duplicate_pairs(df, 3, "0.8", 1)) == truth
    entries = lambda kind: N._posted(df, 3, 1, 4).where(F.col("kind") == kind).agg(F.sum("n")).first()[0] or 0
    few = entries(N._SINGLE) + entries(N._COMMON)
    assert 56 <= entries(N._COMMON) <= 200
    monkeypatch.setattr(N, "_COMMON_SETS", 1 << 30)
    assert entries(N._COMMON) == 0 and entries(N._SINGLE) > few + 28 * 280  # what the licence costs otherwise
    assert {tuple(sorted(r)) for r in N.candidate_pairs(df, 3, Fraction("0.8"), 1).collect()} == {tuple(sorted(r)) for r in links}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 14), min_size=1, max_size=14), min_size=2, max_size=14), st.sampled_from(["0.5", "0.6", "0.8", "1"]))
def test_probes_lose_no_pair(lists, threshold):
    t = Fraction(threshold)
    sets = sorted({frozenset(x) for x in lists}, key=sorted)
    bits = sorted(set().union(*sets))
    holders = {b: frozenset(i for i, x in enumerate(sets) if b in x) for b in bits}
    rows = [(i, int(4 * np.log2(len(holders[b]))), hash(holders[b]) & (2**63 - 1), 1) for i, x in enumerate(sets) for b in x if len(holders[b]) > 1]
    o, v, s, n = N._collapsed(*(np.array(c, np.int64) for c in zip(*rows))) if rows else (np.zeros(0, np.int64),) * 4
    size = np.array([len(x) for x in sets])
    indexed, probed = N.choose_probes(o, v, s, n, size, size, t) if rows else (np.zeros(0, bool),) * 2
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            if a != b and (len(x), a) < (len(y), b) and len(x & y) >= t * len(x | y):
                assert set(s[probed & (o == a)]) & set(s[indexed & (o == b)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text()), max_size=8))
def test_words(texts):
    w = hash_words(texts)
    expect = [words(t) for t in texts]
    assert w.counts.tolist() == list(map(len, expect))
    flat = [x for e in expect for x in e]
    assert [w.word(i) for i in range(len(flat))] == flat
    assert len(set(flat)) == len(set(w.hashes.tolist()))
    for n in (1, 2, 3):
        runs, starts = w.runs(n)
        assert np.diff(starts).tolist() == [max(0, len(e) - n + 1) for e in expect]
        assert len(runs) == starts[-1]
    assert [x for p in pieces(texts) for x in texts[p]] == texts


def test_codes_bound_the_distance():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.unique(pool[rng.integers(0, 400, 90)]), np.unique(pool[rng.integers(0, 400, 90)])
    codes = N.parity_codes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).view(np.uint64)
    assert sum(int(x).bit_count() for x in codes[0] ^ codes[1]) <= len(set(a) ^ set(b))
