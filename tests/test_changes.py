"""Snapshot changes and incremental batches."""

import datetime as dt
import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tesserine.operators import incremental as I
from tesserine.operators import snapshots as S

T0 = dt.datetime(2026, 1, 1)
SNAP = "project_id long, snapshot_no int, path string, content_hash string, received_at timestamp_ntz, size_bytes long, _seq string"
MAN = "project_id long, snapshot_no int, is_complete boolean, _last string"


def changes(spark, rows, manifests):
    snaps = spark.createDataFrame([(p, n, f, h, t, 1, "x") for p, n, f, h, t in rows], SNAP)
    mans = spark.createDataFrame([(*m, "x") for m in manifests], MAN)
    return sorted(tuple(r) for r in S.file_changes(snaps, mans).select("project_id", "path", "snapshot_no", "change_type").collect())


def model(rows, manifests):
    """The definition, over dictionaries."""
    best = {}
    for p, n, f, h, t in rows:
        if p is None or n is None or f is None:
            continue
        key = (p, n, f.replace("\\", "/"))
        new = (t is not None, t or T0, h is not None, (h or "").lower())
        best[key] = max(best.get(key, new), new)
    out = []
    for p in {m[0] for m in manifests}:
        complete = sorted({n for q, n, ok in manifests if q == p and ok})
        before = None
        for n in complete:
            now = {f: (v[3] if v[2] else None) for (q, k, f), v in best.items() if (q, k) == (p, n)}
            if before is not None:
                now = {f: before.get(f) if h is None else h for f, h in now.items()}
                out += [(p, f, n, "added") for f in now if f not in before]
                out += [(p, f, n, "removed") for f in before if f not in now]
                out += [(p, f, n, "changed") for f in now if f in before and now[f] != before[f] and now[f] is not None]
            before = now
    return sorted(out)


def test_dirty_rows(spark):
    rows = [
        (1, 1, "a\\b", "AA", T0), (1, 1, "a/b", "aa", T0), (1, 1, "c", None, T0), (1, 1, None, "x", T0), (None, 1, "a", "x", T0),
        (1, 2, "zzz", "incomplete", T0), (1, 3, "a/b", None, T0), (1, 3, "c", "cc", T0), (1, 3, "d", "dd", T0), (1, 3, "d", "d2", T0 + dt.timedelta(1)),
        (1, 4, "a/b", "aB", T0), (1, 4, "d", "D2", None), (2, 1, "q", "1", T0),
    ]
    mans = [(1, 1, True), (1, 2, False), (1, 2, None), (1, 3, True), (1, 4, True), (1, 4, True), (1, 5, True), (2, 1, True)]
    assert changes(spark, rows, mans) == model(rows, mans)
    assert (1, "c", 4, "removed") in changes(spark, rows, mans)
    assert changes(spark, [], mans) == [] and changes(spark, rows, []) == []


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(1, 5), st.sampled_from("ab/c"), st.sampled_from([None, "x", "Y", "z"]), st.integers(0, 3)), max_size=40), st.lists(st.booleans(), min_size=10, max_size=10))
def test_against_model(spark, raw, complete):
    rows = [(p, n, f, h, T0 + dt.timedelta(d)) for p, n, f, h, d in raw]
    mans = [(p, n, ok) for (p, n), ok in zip(itertools.product((1, 2), range(1, 6)), complete)]
    assert changes(spark, rows, mans) == model(rows, mans)


def test_one_range_shuffle(spark):
    """The merge reuses the range exchange: the windows over it add no exchange and no sort."""
    rows = spark.createDataFrame([(1, 1, "a", "x", T0, 1, "x")], SNAP)
    mans = spark.createDataFrame([(1, 1, True, "x")], MAN)
    plan = S.snapshot_changes(S.file_listing(rows), S.complete_sequence(mans, "project_id", "snapshot_no", "is_complete"))._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Exchange rangepartitioning")  # plans are printed from the top
    assert "Exchange" not in above and above.count("+- Sort") == 1 and "rangepartitioning" not in below


def test_delivered_listings(spark, tmp_path):
    store = S.SnapshotStore(spark, f"file://{tmp_path}", "g bigint, k string", "h string, n int")
    give = lambda *rows: sorted((r["g"], r["k"], r["change_type"], r["changed_columns"]) for r in store.deliver(spark.createDataFrame([(*r, "x") for r in rows], "g long, k string, h string, n int, _a string")).collect())
    assert give((1, "a", "x", 1), (1, "b", "y", 2), (2, "a", "q", None)) == []
    assert give((1, "a", None, 3), (1, "c", "z", None)) == [(1, "a", "changed", ["n"]), (1, "b", "removed", []), (1, "c", "added", [])]
    assert give((1, "a", "x", None), (1, "c", "w", 9), (3, "z", "z", 0)) == [(1, "c", "changed", ["h", "n"])]
    assert give((2, "a", None, None), (2, "b", None, None)) == [(2, "b", "added", [])]
    assert sorted((r["g"], r["k"], r["h"], r["n"]) for r in store.latest().collect()) == [(1, "a", "x", 3), (1, "c", "w", 9), (2, "a", "q", None), (2, "b", None, None), (3, "z", "z", 0)]
    assert give() == [] and store.latest().count() == 5
    none, groups = spark.createDataFrame([], "g long, k string, h string, n int"), spark.createDataFrame([(3,), (4,)], "g long")
    assert [(r["g"], r["k"], r["change_type"]) for r in store.deliver(none, groups).collect()] == [(3, "z", "removed")]
    assert give((4, "a", "x", 1)) == [(4, "a", "added", [])]  # after an empty first listing


ROWS = "k long, h string, at long, extra string"


class Work:
    """A log of (k, h, at), its batches and its sink."""

    def __init__(self, spark, folder, partitions=4):
        self.spark, self.log = spark, I.ChangeLog(spark, f"file://{folder}/log", "k bigint", partitions)
        self.batches, self.sink = I.BatchLog(spark, f"file://{folder}/batches", self.log), I.DedupSink(spark, f"file://{folder}/sink", ["k"])

    def arrive(self, *rows):
        self.log.capture(self.spark.createDataFrame([(*r, "x") for r in rows], ROWS), "h", "at")

    def run(self, process=None, bare=None):
        incomplete = None if bare is None else self.spark.createDataFrame([(b,) for b in bare], "k long")
        name = I.run_batch(self.batches, self.sink, process or (lambda e: e), incomplete)
        return None if name is None else sorted((r["k"], r["stamp"], r["reason"]) for r in self.batches.read_plan(name).collect())

    def held(self):
        return sorted((r["k"], r["stamp"]) for r in self.sink.read().collect())


def test_capture_gives_rising_offsets(spark, tmp_path):
    w = Work(spark, tmp_path)
    w.arrive((1, "a", 5), (1, "b", 5), (1, "b", 5), (2, None, None), (None, "x", 9), (3, "c", 1))
    w.arrive((1, "b", 5), (1, "late", 0), (2, None, None), (4, "d", 2))
    rows = w.log.entries().collect()
    assert sorted((r["k"], r["stamp"] or "", -1 if r["time"] is None else r["time"]) for r in rows) == [(1, "a", 5), (1, "b", 5), (1, "late", 0), (2, "", -1), (3, "c", 1), (4, "d", 2)]
    by_part = {}
    for r in rows:
        by_part.setdefault(r["log_partition"], []).append(r["offset"])
    assert all(sorted(v) == list(range(len(v))) for v in by_part.values())
    at = {r["stamp"]: r["offset"] for r in rows if r["k"] == 1}
    assert at["a"] < at["b"] < at["late"]


def test_change_with_an_equal_time_is_not_lost(spark, tmp_path):
    w = Work(spark, tmp_path)
    w.arrive((1, "A", 100))
    assert w.run() == [(1, "A", "new")] and w.run() is None
    w.arrive((1, "A", 100), (1, "0", 100))  # neither a later time nor a larger stamp
    assert w.run() == [(1, "0", "changed")] and w.run() is None
    assert w.held() == [(1, "0"), (1, "A")]


def test_late_and_settled_versions(spark, tmp_path):
    w = Work(spark, tmp_path)
    w.batches.adopt(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, done_stamp string"))
    w.arrive((1, "a", 10), (2, "b2", 10), (3, None, 10), (4, "d", 10))
    assert w.run() == [(2, "b2", "changed"), (4, "d", "new")]
    w.arrive((1, "old", 3), (2, "old", 9), (5, "late", 1), (4, "d", 11))  # old versions, a new key with an old time, a touch
    assert w.run() == [(5, "late", "new")]
    assert w.run(bare=[1, 1, 99]) == [(1, "a", "incomplete")]
    assert w.run(bare=[]) is None


def test_crashes_repeat_and_skip_nothing(spark, tmp_path):
    w = Work(spark, tmp_path)
    w.arrive((1, "a", 1), (2, "b", 2))

    def half(e):
        w.sink.write(e.where("k = 1"), "unfinished")  # noise that no plan stands for
        raise RuntimeError

    with pytest.raises(RuntimeError):
        w.run(half)
    name = w.batches.open_plan()
    w.sink.write(w.batches.read_plan(name), name)  # a crash between sink and commit
    w.arrive((1, "a2", 7), (3, "late", 0))
    assert w.batches.open_plan() == name and w.batches.offsets() == {}
    assert w.run() == [(1, "a", "new"), (2, "b", "new")]  # as it stands
    assert w.run() == [(1, "a2", "changed"), (3, "late", "new")]
    assert w.run() is None and w.held() == [(1, "a"), (1, "a2"), (2, "b"), (3, "late")]


def test_state_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "COMPACT", 2)
    w = Work(spark, tmp_path)
    for i in range(5):
        w.arrive((i % 2, f"v{i}", i))
        assert [r[1] for r in w.run()] == [f"v{i}"]
    assert len(w.batches.names("states")) == 2
    assert {r["k"]: r["done_stamp"] for r in w.batches.state().collect()} == {0: "v4", 1: "v3"} and w.run() is None


def test_committed_state(spark):
    runs = spark.createDataFrame([(1, "ok", 10), (2, "failed", 20), (3, "ok", 5), (4, "running", None)], "run_id long, state string, finished_at long")
    handled = spark.createDataFrame([(1, 1, "a"), (3, 1, "stale"), (2, 2, "b"), (1, 3, "old"), (1, 4, None)], "run_id long, k long, h string")
    assert {r["k"]: r["done_stamp"] for r in I.committed_state(handled, runs, ["k"], "h").collect()} == {1: "a", 3: "old", 4: None}


FILES, RUNS, HANDLED = "project_id long, path string, content_hash string, indexed_at long, path_2 string", "run_id long, state string, finished_at long", "run_id long, project_id long, path string, content_hash string"


def test_pending_files_empty(spark):
    e = lambda s: spark.createDataFrame([], s)
    assert I.pending_files(e(FILES), e(RUNS), e(HANDLED), e("id long, project_id long, path string"), e("chunk_rowid long")).count() == 0


def test_index_runs_after_a_failed_one(spark, tmp_path):
    files = spark.createDataFrame([(1, "a", "h1", 5, "x"), (1, "b", "h2", 5, "x"), (1, "c", "h3", 5, "x"), (1, "d", "h4", 5, "x")], FILES)
    runs, handled = spark.createDataFrame([(1, "ok", 10)], RUNS), spark.createDataFrame([(1, 1, "a", "h1"), (1, 1, "b", "old"), (1, 1, "d", "h4")], HANDLED)
    chunks, vectors = spark.createDataFrame([(7, 1, "d"), (8, 1, "a")], "id long, project_id long, path string"), spark.createDataFrame([(8,)], "chunk_rowid long")
    expect = [("b", "changed"), ("c", "new"), ("d", "incomplete")]
    pick = lambda df: sorted((r["path"], r["reason"]) for r in df.collect())
    assert pick(I.pending_files(files, runs, handled, chunks, vectors)) == expect
    work = I.IndexRuns(spark, f"file://{tmp_path}")
    work.adopt(runs, handled)
    with pytest.raises(ZeroDivisionError):
        work.run(files, chunks, vectors, lambda e: 1 / 0)
    assert pick(work.run(files, chunks, vectors)) == expect
    assert work.run(files, chunks, spark.createDataFrame([(7,), (8,)], "chunk_rowid long")) is None
