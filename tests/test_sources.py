"""Directory walk, store, embedding, streams, reports."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tesserine.operators import status
from tesserine.sources import embedding as E
from tesserine.sources.store import ChunkStore, StaleWriter
from tesserine.sources.walk import observe, parse_rules, read_tree, verdict
from tesserine.streaming import changes as C


def tree(root, files):
    for path, text in files.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_walk(spark, tmp_path):
    tree(tmp_path, {
        ".gitignore": "*.log\n/build/\n!keep.log\ndeep/**/x.txt\n", ".indexignore": "!build/\nsecret.*\n", ".env": "A=1", "a.log": "x", "keep.log": "x", "build/out.txt": "x", "secret.txt": "x",
        "deep/1/2/x.txt": "x", "deep/1/y.txt": "x", "sub/.gitignore": "*.txt\n", "sub/a.txt": "x", "sub/b.md": "é", "sub/c/d.txt": "x", ".git/config": "x", "sub/.GIT/y": "x", "_u/f": "x",
        "vendor/.git/HEAD": "x", "vendor/v.c": "x", ".hidden/h": "x",
    })
    os.symlink("/etc", tmp_path / "link")
    rows = {r["path"]: r for r in read_tree(spark, str(tmp_path), ignore="_u/\n").collect()}
    assert set(rows) == {".gitignore", ".indexignore", ".env", "keep.log", "build/out.txt", "deep/1/y.txt", "sub/.gitignore", "sub/b.md", ".hidden/h", "link"}
    assert rows["link"]["link"] == "/etc" and rows["sub/b.md"]["sha256"] == hashlib.sha256("é".encode()).hexdigest() and rows["sub/b.md"]["size"] == 2
    (tmp_path / ".indexignore").write_text("!vendor/\n")
    assert "vendor/v.c" in {r["path"] for r in read_tree(spark, str(tmp_path)).collect()}
    seen, bad = observe(spark, str(tmp_path), ["sub", "keep.log", "gone"])
    assert {r["path"] for r in seen.collect()} == {"sub/.gitignore", "sub/b.md", "keep.log"} and bad.count() == 0


@pytest.mark.parametrize("rule,path,folder,expect", [
    ("*.o", "a/b.o", False, True), ("/x", "a/x", False, None), ("/x", "x", False, True), ("a/b", "a/b", False, True), ("a/b", "c/a/b", False, None), ("d/", "d", False, None), ("d/", "d", True, True),
    ("**/q", "a/b/q", False, True), ("a/**", "a/b/c", False, True), ("a/**/b", "a/b", False, True), ("[!a].c", "b.c", False, True), ("[!a].c", "a.c", False, None), ("!x", "x", False, False), ("\\#x", "#x", False, True), ("#x", "#x", False, None), ("x ", "x", False, True),
])
def test_rules(rule, path, folder, expect):
    assert verdict(parse_rules(rule, ""), path, folder) is expect


def files(spark, contents):
    return spark.createDataFrame([(p, c.encode()) for p, c in contents.items()], "path string, content binary")


def test_store_end_to_end(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    one = store.register("/r/one", "One")
    two = store.register("/r/two", "Two", "session")
    assert (one, two) == (1, 2) and store.register("/r/one", "One!") == 1
    with pytest.raises(ValueError):
        store.register("/r/three", "TWO")
    got = store.index(one, files(spark, {"a.md": "# A\nfirst text here\n# B\nsecond text here\n", "b.txt": "hello world"}))
    assert got == {"new": 2} and store.table("chunks").count() == 3
    ids = {r["anchor"]: r["id"] for r in store.table("chunks").collect()}
    # An edit of one section keeps the other one's row, and with it its vector.
    store.publish(store.current(), {"chunk_vectors": spark.createDataFrame([(i, one, 2, [1.0, 0.0]) for i in ids.values()], "chunk_rowid long, project_id long, dims int, vector array<float>")})
    got = store.index(one, files(spark, {"a.md": "# A\nfirst text here\n# B\nanother text here\n", "b.txt": "hello world"}))
    assert got == {"changed": 1, "unchanged": 1}
    after = {r["anchor"]: r["id"] for r in store.table("chunks").collect()}
    assert after["md:A"] == ids["md:A"] and after["md:B"] != ids["md:B"] and len(set(after.values())) == 3
    assert {r["chunk_rowid"] for r in store.table("chunk_vectors").collect()} == set(ids.values()) & set(after.values())
    before = store.current().generation
    assert store.index(one, files(spark, {"a.md": "# A\nfirst text here\n# B\nanother text here\n", "b.txt": "hello world"})) == {"unchanged": 2}
    assert store.current().generation == before  # nothing changed, nothing published
    assert store.index(one, files(spark, {"b.txt": "hello world"})) == {"deleted": 1, "unchanged": 1} and store.table("chunks").count() == 1
    assert store.set_profile(one, "lore-v1", "rank") and not store.set_profile(one, "lore-v1", "rank")
    assert store.reconcile_fingerprint({"model": "m", "dims": 2}) == "adopted" and store.reconcile_fingerprint({"model": "m", "dims": 2}) == "kept"
    assert store.reconcile_fingerprint({"model": "n", "dims": 3}) == "cleared" and store.table("chunk_vectors").count() == 0
    store.remove(one)
    assert store.table("chunks").count() == 0 and store.register("/r/one", "One") == 3  # ids are never used again
    store.apply_projects([{"root": "/r/two", "name": "Both"}, {"root": "/r/new", "name": "both"}, {"root": "/r/new", "name": "again"}])
    assert [(r["id"], r["name"]) for r in store.projects().collect()] == [(2, "Both"), (4, "both (2)")]


def test_guard_and_fence(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    p = store.register("/r", "R")
    store.index(p, files(spark, {f"f{i}.txt": f"text {i}" for i in range(110)}))
    few = files(spark, {"f0.txt": "text 0"})
    with pytest.raises(RuntimeError):
        store.index(p, few)
    assert store.table("files").count() == 110
    old = store.acquire("r")
    new = store.acquire("r")
    with pytest.raises(StaleWriter):
        store.index(p, few, override=True, epoch=("r", old))
    assert store.index(p, few, override=True, epoch=("r", new))["deleted"] == 109
    base = store.current()
    store.publish(base, {})
    with pytest.raises(StaleWriter):
        store.publish(base, {})  # two writers of one generation


def test_embedding(spark):
    assert [(s.start, s.stop) for s in E.batches(["a" * 5, "b" * 5, "c" * 50, "d"], 2, 12)] == [(0, 2), (2, 3), (3, 4)]
    assert E.ordered_answer([(1, [2.0]), (0, [1.0])], 2) == [[1.0], [2.0]]
    for bad in ([(0, [1.0])], [(0, [1.0]), (0, [1.0])], [(0, []), (1, [1.0])], [(0, [1.0]), (5, [1.0])]):
        with pytest.raises(ValueError):
            E.ordered_answer(bad, 2)
    with pytest.raises(ValueError):
        E.ordered_answer([(0, [1.0, 2.0])], 1, dims=3)
    assert [E.retryable(E.RequestError(*x)) for x in ((429,), (503,), (400,), (400, "dial tcp"), (404, "no"))] == [True, True, False, True, False]
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise E.RequestError(429, retry_after=999)
        return [[1.0]] * len(texts)

    waits = []
    assert E.call(flaky, ["a"], sleep=waits.append) == [[1.0]] and waits == [60.0, 60.0]

    def embedder(texts):
        if any("poison" in t for t in texts):
            raise E.RequestError(400)
        return [[0.0, 0.0] if "zero" in t else [3.0, 4.0] for t in texts]

    backlog = spark.createDataFrame([(1, 1, "a"), (2, 1, "poison"), (3, 1, "zero"), (4, 1, "b")], "id long, project_id long, text string")
    got = {r["chunk_rowid"]: (r["vector"] and [round(x, 3) for x in r["vector"]], r["failed"]) for r in E.embed(backlog, embedder, 2).collect()}
    assert got == {1: ([0.6, 0.8], None), 4: ([0.6, 0.8], None), 2: (None, "status 400"), 3: (None, "unusable vector")}
    known = spark.createDataFrame([], "chunk_rowid long, strikes int, retry_at long")
    failures = spark.createDataFrame([(2, "status 400"), (3, "unusable vector")], "chunk_rowid long, failed string")
    first = E.poison(known, failures, 1000)
    assert {r[0]: (r[1], r[2]) for r in first.collect()} == {2: (1, 1060), 3: (2, 1720)}
    assert {r["id"] for r in E.due(backlog, first, 1100).collect()} == {1, 2, 4}
    assert {r[0]: r[1] for r in E.poison(first, failures.where("chunk_rowid = 2"), 1100).collect()} == {2: 2, 3: 2}
    seen = spark.createDataFrame([("x", "ok", 5), ("x", "down", 3)], "label string, status string, ticket long")
    assert E.latest_health(seen).first()["status"] == "ok"


def test_routing(spark):
    rows = [
        (1, "a.rs", "modify", None), (1, "a.rs", "modify", True), (1, ".git/x", "modify", None), (1, "b.rs", "access", None), (2, "sub/.gitignore", "modify", None), (2, "c.rs", "modify", None),
        (3, ".index.toml", "modify", None), (3, "d.rs", "modify", None), (4, None, "rescan", None), (5, "x/.index.toml", "modify", None),
    ]
    work = C.coalesce(C.route(spark.createDataFrame(rows, C.EVENT_FIELDS)))
    got = {r["project_id"]: (r["scope"], r["paths"], r["override"]) for r in work.collect()}
    assert got == {1: ("path", ["a.rs"], True), 2: ("full", None, False), 3: ("reload", None, False), 4: ("full", None, False), 5: ("path", ["x/.index.toml"], False)}
    many = spark.range(20).select(F.lit(1).alias("project_id"), F.concat(F.lit("f"), "id").alias("path"), F.lit("modify").alias("kind"), F.lit(None).cast("boolean").alias("override"))
    assert C.coalesce(C.route(many), 10).first()["scope"] == "full"
    lost = spark.createDataFrame([(None, None, "rescan", None), (1, "a", "modify", None)], C.EVENT_FIELDS)
    projects = spark.createDataFrame([(1,), (2,)], "id long")
    assert {r["project_id"]: r["scope"] for r in C.all_projects(C.coalesce(C.route(lost)), projects).collect()} == {1: "full", 2: "full"}


def test_stream(spark, tmp_path):
    src, seen = tmp_path / "events", []
    spark.createDataFrame([(1, "a.rs", "modify", None), (1, "a.rs", "modify", None), (2, ".gitignore", "modify", None)], C.EVENT_FIELDS).coalesce(1).write.json(str(src))
    events = spark.readStream.schema(C.EVENT_FIELDS).json(str(src))
    handle = lambda s, work, n: seen.append(sorted((r["project_id"], r["scope"]) for r in work.collect()))
    C.run_stream(events, handle, str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert seen == [[(1, "path"), (2, "full")]]
    C.run_stream(events, handle, str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert len(seen) == 1  # nothing new, nothing repeated


def test_reports(spark):
    samples = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 1, 4, 2, 3])] + [("a", 9, None)], "label string, at long, value double")
    r = status.latency_percentiles(samples, "label", "at", "value", window=4).first()
    assert (r["n"], r["n_total"], r["p50"], r["max"]) == (4, 5, 2.0, 4.0)
    c = status.client_percentiles(samples, "label", "value").first()
    assert (c["n"], c["mean"], c["p50"], c["p95"]) == (5, 3.0, 3.0, 5.0)
    t = status.throughput(spark.createDataFrame([("x", 10, 100, 2_000_000, 0.0, 1.0), ("x", 10, 100, 2_000_000, 1.0, 4.0)], "label string, chunks int, tokens int, bytes long, started double, ended double")).first()
    assert (t["chunks_per_s"], t["tokens_per_s"], t["mb_per_s"], t["p50_ms"], t["p95_ms"]) == (5.0, 50.0, 1.0, 2000.0, 3000.0)
    shown = spark.createDataFrame([("s", "a", 1), ("s", "b", 1)], "session string, path string, at int")
    opened = spark.createDataFrame([("s", "a", 2), ("s", "b", 0)], "session string, path string, at int")
    assert tuple(status.uptake(shown, opened).first()) == ("s", 2, 1)
    assert tuple(status.fleet_totals(spark.createDataFrame([], "chunks long, embedded long")).first()) == (0, 0, 0)
    log = spark.createDataFrame([('{"tool":"x","started":1,"ended":3.5}',), ("junk",), ('{"tool":"y","started":3,"ended":1}',)], "value string")
    assert [tuple(r) for r in C.tool_events(log).collect()] == [("x", 2.5, 1.0)]
    chunks = spark.createDataFrame([(f"{i:03d}", 1, "é" * 10) for i in range(10)], "chunk_id string, project_id long, text string")
    got = status.sample_fixture(chunks, 3, 5).collect()
    assert sorted(r["chunk_id"] for r in got) == ["000", "003", "006"] and got[0]["text"] == "éé"


def test_scope_lists_what_is_named_alone(spark, tmp_path, monkeypatch):
    from tesserine.sources import walk as W

    for name in ("a/x.txt", "a/b/y.txt", "a/skip/z.txt", "c/w.txt", "c/.git/HEAD", "top.txt", "other.log", "sub/.git/HEAD", "sub/in.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / ".gitignore").write_text("skip/\n*.log\n")
    whole = {r["path"] for r in W.observe(spark, str(tmp_path))[0].collect()}
    assert whole == {".gitignore", "a/x.txt", "a/b/y.txt", "top.txt"}
    for scope in (["a"], ["a/b", "a"], ["top.txt", "a/x.txt"], ["a/skip", "other.log", "sub/in.txt", "gone", "../x", "a/skip/z.txt", "c/.git/HEAD"], ["", "a"], []):
        got = [r["path"] for r in W.observe(spark, str(tmp_path), scope)[0].collect()]
        assert len(got) == len(set(got)) and set(got) == {p for p in whole if any(s == "" or p == s or p.startswith(s + "/") for s in scope)}
    read = []
    monkeypatch.setattr(W.Walker, "listing", lambda self, folder, rules: read.append(folder) or ([], []))
    assert len(W._Reader({"path": str(tmp_path), "scope": "a\ntop.txt"}).partitions()) == 2 and read == []


def test_http_embedder(spark):
    import http.server
    import json
    import threading

    from tesserine.sources import embedding as E

    seen = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body["model"])
            if len(seen) == 1:
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
            raw = json.dumps({"data": data[::-1]} if body["model"] != "broken" else {"oops": 1}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    assert E.call(E.HttpEmbedder(base, "m"), ["a", "bbb"], sleep=lambda s: None) == [[1.0, 1.0], [3.0, 1.0]]
    with pytest.raises(ValueError):
        E.call(E.HttpEmbedder(base, "broken"), ["a"])
    with pytest.raises(ValueError):
        E.call(E.HttpEmbedder(base, "m", dims=3), ["a"])
    rows = spark.createDataFrame([(1, 7, "ab"), (2, 7, "abc")], "id long, project_id long, text string")
    assert {r["chunk_rowid"]: r["failed"] for r in E.embed(rows, E.HttpEmbedder(base, "m"), 1).collect()} == {1: None, 2: None}
    server.shutdown()
    with pytest.raises(E.RequestError):
        E.call(E.HttpEmbedder("http://127.0.0.1:9", "m"), ["a"], attempts=1)
    assert E.wait_seconds("7") == 7 and E.wait_seconds("Thu, 01 Jan 1970 00:01:00 GMT", 50.0) == 10 and E.wait_seconds("soon") is None


def test_registry_file(spark, tmp_path):
    from tesserine.sources.registry import Registry, parse_registry, render_registry
    from tesserine.sources.store import ChunkStore

    store = ChunkStore(spark, f"file://{tmp_path}/store")
    store.register("/a", "Alpha")
    store.register("/b", 'Be"ta\\', "session")
    registry, file = Registry(store), tmp_path / "store" / "projects.toml"
    assert registry.reconcile().bootstrapped
    held = parse_registry(file.read_text())
    assert [(p["root"], p["name"], p["kind"], p["key"]) for p in held] == [("/a", "Alpha", "repo", "alpha"), ("/b", 'Be"ta\\', "session", "be-ta")]
    file.write_text(render_registry([{**held[1], "name": "Beta"}, {"name": "beta", "root": "/c", "key": "third"}]))
    done = registry.reconcile()
    assert (done.bootstrapped, done.inserted, done.updated, done.removed) == (False, 1, 1, 1)
    rows = {r["root"]: (r["id"], r["name"], r["project_key"]) for r in store.projects().collect()}
    assert rows == {"/b": (2, "Beta", "be-ta"), "/c": (3, "beta (2)", "third")}
    for bad in ("[[project]]\nname = 'x'\n", "[[project]]\nname = 'x'\nroot = '/x'\ncolour = 'red'\n", "[other]\n", "not toml", "[[project]]\nname = 'x'\nroot = '/x'\nkind = 'odd'\n"):
        file.write_text(bad)
        assert registry.reconcile().quarantined and file.with_suffix(".toml.damaged").read_text() == bad
        assert len(parse_registry(file.read_text())) == 2 and store.projects().count() == 2


def test_streams_start_again():
    from tesserine.streaming import changes as C

    class Query:
        def __init__(self, fails, progress):
            self.fails, self.lastProgress = fails, progress

        def awaitTermination(self):
            if self.fails:
                raise RuntimeError("lost")

    waits = []
    runs = iter([Query(True, None), Query(True, None), Query(True, {"batchId": 4}), Query(True, None), Query(False, None)])
    assert C.keep_running(lambda: next(runs), sleep=waits.append, first=1, cap=3) == 4 and waits == [1, 2, 1, 2]
    with pytest.raises(RuntimeError):
        C.keep_running(lambda: Query(True, None), attempts=3, sleep=waits.append)
