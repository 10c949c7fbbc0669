"""Queries that must take in their whole tables, over small hand-made ones."""

import pytest

from tesserine.plans import index_queries as Q
from tests.oracle import rows_of

DOCUMENTS = "doc_id long, project_id long, text string"


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, kind) in tables.items():
            spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_decisions(spark, folder):
    docs = [
        (1, 7, "intro\r\n## D-0001 — a\r\n\r\n- **Status:** Accepted\r\n## D-0002 — b\r\n- **Status:** Proposed\r\n"),
        (2, 7, "## D-0003\n- **Status:** Accepted.\n- **Supersedes:** D-0001, and D-0002\n"),
        (3, 8, "### D-0001 c\n* **Status**: accepted\n"), (4, 8, "## D-00012\n- **Status:** Accepted\n"),
        (5, None, "## D-0009\n- **Status:** Accepted\n"), (6, 8, None), (7, 8, "no decision"),
    ]
    chunks = [(i, p, "a.md", "decided", f'{{"decision_refs": ["{d}"]}}', 1, None) for i, p, d in ((1, 7, "D-0001"), (2, 7, "D-0003"), (3, 8, "D-0001"), (4, 8, "D-0003"))]
    sf = folder(
        documents=(docs, DOCUMENTS), projects=([(p, "repo", "lore-v1", "rank") for p in (7, 8)], "id long, kind string, authority_profile string, authority_behavior string"),
        chunks=(chunks, "id long, project_id long, path string, design_status string, vault string, effective_tier int, demotion string"))
    assert sorted(map(tuple, Q.ledger_active(spark, sf).collect())) == [(7, "D-0003"), (8, "D-0001")]
    assert sorted((r.id, r.accepted) for r in Q.ledger_decisions(spark, sf).collect()) == [("D-0001", True), ("D-0001", True), ("D-0002", False), ("D-0003", True)]
    assert sorted((r.id, r.tier) for r in Q.effective_tiers(spark, sf).collect()) == [(1, 1), (2, 3), (3, 3), (4, 1)]
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "projects", "chunks"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    from tests.oracle import rows_of_sql

    for name in ("ledger_active", "ledger_decisions", "effective_tiers"):
        assert rows_of(Q.QUERIES[name](spark, sf)) == rows_of_sql(con, Q.SQL[name])


def test_snapshot_pairs(spark, folder):
    """Snapshot 3 is cut short: 4 is compared with 2, and nothing of 3 counts as gone."""
    listings = {1: "a:1 b:1 src/c:1", 2: "a:2 b: src/c:1", 3: "a:2", 4: "a:2 b:1 src/d:", 6: "a:2 b:3 src/d:9"}
    rows = [(5, n, p, h or None, f"2026-01-0{n} 00:00:00") for n, x in listings.items() for p, h in (f.split(":") for f in x.split())]
    sf = folder(
        file_snapshots=(rows, "project_id long, snapshot_no int, path string, content_hash string, received_at string"),
        manifests=([(5, n, n != 3) for n in (1, 2, 3, 4, 6)] + [(5, 7, True)], "project_id long, snapshot_no int, is_complete boolean"),
        projects=([(5,)], "id long"))
    got = {(r.snapshot_no, r.path): r.state for r in Q.manifest_diff(spark, sf).collect()}
    assert {k for k, s in got.items() if s == "deleted"} == {(4, "src/c"), (7, "a"), (7, "b"), (7, "src/d")}
    assert {k for k, s in got.items() if s == "changed"} == {(2, "a"), (6, "b"), (6, "src/d")} and {k for k, s in got.items() if s == "new"} == {(4, "src/d")}
    assert {(r.snapshot_no, r.path) for r in Q.scoped_diff(spark, sf).collect()} == {k for k in got if k[1].startswith("src/")}
    assert {(r.snapshot_no, r.path) for r in Q.manifest_needs(spark, sf).collect()} == {k for k, s in got.items() if s in ("new", "changed")}
    assert {(r.snapshot_no, r.deletes, r.stored, r.refused) for r in Q.mass_delete_guard(spark, sf).collect()} == {(2, 0, 3, False), (4, 1, 3, False), (6, 0, 3, False), (7, 3, 3, False)}
    assert {(r.snapshot_no, r.seen, r.n_new, r.n_changed, r.n_deleted) for r in Q.pass_summary(spark, sf).collect()} == {(2, 3, 0, 1, 0), (4, 3, 1, 0, 1), (6, 3, 0, 2, 0), (7, 0, 0, 0, 3)}


def test_active_decisions_are_counted(spark):
    from tesserine.operators import status

    none = spark.createDataFrame([], "project_id long, path string, id long, demotion string, chunk_rowid long")
    decisions = spark.createDataFrame([(1, "D-0001"), (1, "D-0002"), (1, "D-0002"), (3, "D-0009")], "project_id long, id string")
    got = status.status_counts(spark.createDataFrame([(1,), (2,)], "id long"), none, none, none, decisions)
    assert sorted((r.project_id, r.active_decisions) for r in got.collect()) == [(1, 2), (2, 0)]


def test_containing_projects(spark):
    from tesserine.operators.indexing import containing_projects

    projects = spark.createDataFrame([(1, "/a"), (2, "/a/b/"), (3, "/ab"), (4, "/")], "id long, root string")
    paths = spark.createDataFrame([("/a/b/x.md",), ("/a/b",), ("/ab/y",), ("/c",)], "path string")
    assert sorted(map(tuple, containing_projects(paths, projects).collect())) == [
        ("/a/b", 1), ("/a/b", 2), ("/a/b", 4), ("/a/b/x.md", 1), ("/a/b/x.md", 2), ("/a/b/x.md", 4), ("/ab/y", 3), ("/ab/y", 4), ("/c", 4)]


def test_large_files_are_skipped(spark, folder):
    """Documents that are repeated until they are too large, also where a fixed number of repetitions would be gigabytes.
    2041 bytes and the padding are a divisor of the limit."""
    from tests.oracle import rows_of_sql

    texts = {103: "x" * 8000, 203: "y" * 2041, 303: "", 403: None, 503: "\u00e9" * 5000, 603: "z" * 2_200_000, 101: "a", 102: "b", 104: "c\n" * 600, 204: "c\n" * 6, 5: "d", 7: "e" * 4097}
    sf = folder(documents=([(i, 1, t) for i, t in texts.items()], DOCUMENTS))
    got = {r.path: r.reason for r in Q.skip_reasons(spark, sf).collect()}
    assert {p for p, why in got.items() if why == "too large"} == {f"d/{i}{'.md' if i % 3 == 0 else '.txt'}" for i in texts if i % 100 == 3}
    assert {p: why for p, why in got.items() if why != "too large"} == {"d/101.txt": "binary", "d/102.md": "invalid utf-8", "d/104.txt": "machine text", "d/7.txt": "machine text"}
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    assert rows_of(Q.skip_reasons(spark, sf)) == rows_of_sql(con, Q.SQL["skip_reasons"])
