"""The engine through its own calls."""

import hashlib

import pytest

from tesserine.api import Engine, parse_settings
from tesserine.operators.chunking import Plugin
from tesserine.sources.store import StaleWriter
from tesserine.streaming import changes as C

PROFILE = '[authority]\nprofile = "lore-v1"\nbehavior = "rank"\n'


def write(root, files):
    for path, text in files.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text)


def test_settings():
    s = parse_settings(PROFILE + '[[sources]]\npath = "../x"\nmount = "m"\n')
    assert s.profile is None and "relative" in s.error
    s = parse_settings(PROFILE.replace('behavior = "rank"\n', "") + '[plugins]\nenable = ["a"]\n')
    assert (s.profile, s.behavior, s.plugins, s.error) == ("lore-v1", "annotate", ("a",), None)
    for bad in ("nonsense", "[other]\n", '[authority]\nprofile = "x"\n', "[authority]\nextra = 1\n"):
        assert parse_settings(bad).error and parse_settings(bad).profile is None
    assert parse_settings(None) == parse_settings("")


def test_index_search_expand(spark, tmp_path):
    root, other = tmp_path / "one", tmp_path / "two"
    write(root, {
        ".index.toml": PROFILE, "design/0_Canon/DECISIONS.md": "## D-0001 — Use leases\n- **Status:** Accepted\nleases fence writers\n",
        "design/a.md": "---\ndesign_status: decided\ndecision_refs: [D-0001]\n---\n# Leases\nleases fence stale writers here\n",
        "design/b.md": "---\ndesign_status: decided\ndecision_refs: [D-0009]\n---\n# Claims\nleases fence stale writers here too\n", "src/x.py": "def lease():\n    return 'writers'\n",
    })
    write(other, {"n.txt": "leases in another project\n"})
    e = Engine(spark, f"file://{tmp_path}/store")
    one, two = e.add(str(root), "One"), e.add(str(other), "Two")
    assert e.index("one")["new"] == 5 and e.index("two")["new"] == 1
    assert e.resolve(str(root / "src/x.py")) == one and e.resolve("/nowhere") is None
    rows, flag = e.search("leases fence", "one")
    got = {r["path"]: r for r in rows.collect()}
    assert got["design/a.md"]["authority"] == 3 and got["design/b.md"]["authority"] == 1 and got["design/b.md"]["authority_note"] == "uncited_decided" and flag.first()[0]
    assert [r["path"] for r in e.files("one").collect()] == sorted([".index.toml", "design/0_Canon/DECISIONS.md", "design/a.md", "design/b.md", "src/x.py"])
    assert [r["anchor"] for r in e.chunks("one", "design/a.md").collect()] == ["md:Leases"]
    assert "n.txt" not in got and {r["path"] for r in e.search("another")[0].collect()} == {"n.txt"}
    write(root, {"src/x.py": "def lease():\n    return 'writer'\n"})
    assert e.index("one", ["src/x.py"]) == {"changed": 1} and e.store.table("decisions").count() == 1  # a partial pass keeps the decisions
    # The decision falls: tiers follow without re-indexing the documents that cite it.
    write(root, {"design/0_Canon/DECISIONS.md": "## D-0001 — Use leases\n- **Status:** Rejected\n"})
    assert e.index("one", ["design/0_Canon"]) == {"changed": 1} and e.store.table("decisions").count() == 0
    assert {r["path"]: r["authority"] for r in e.search("leases fence", "one").__getitem__(0).collect()}["design/a.md"] == 1
    key = got["design/a.md"]["chunk_id"]
    assert e.expand("one", key[:12], 1) == ("found", ["---\n# Leases\nleases fence stale writers here\n"])
    assert e.expand("one", "0" * 8)[0] == "unknown"
    with pytest.raises(ValueError):
        e.expand("one", "xyz")
    # Embedding, then a hybrid search.
    stored, poisoned = e.embed(lambda texts: [[float("leases" in t), 1.0] for t in texts], {"model": "m", "dims": 2})
    assert stored == e.store.table("chunks").count() and poisoned.count() == 0
    rows, flag = e.search("leases", query_vector=[1.0, 1.0])
    assert not flag.first()[0] and rows.count() >= 4
    counts = {r["project_id"]: r for r in e.status().collect()}
    assert counts[one]["files"] == 5 and counts[one]["embedded"] == counts[one]["chunks"] and counts[two]["files"] == 1
    (root / "src/x.py").unlink()
    events = spark.createDataFrame([(one, "src/x.py", "remove", None), (99, "y", "modify", None)], C.EVENT_FIELDS)
    e.handle_changes(spark, C.coalesce(C.route(events)), 0)
    assert e.store.table("files").where(f"project_id = {one}").count() == 4 and e.index("one", ["src"]) == {}
    e.remove("two")
    assert e.search("another")[0].count() == 0


def test_plugins_are_opted_into(spark, tmp_path):
    root = tmp_path / "p"
    write(root, {"a.log": "line\n" * 60, ".index.toml": ""})
    e = Engine(spark, f"file://{tmp_path}/store", plugins=(Plugin("logs", ("log",), lines=20),))
    e.add(str(root), "P")
    e.index("p")
    assert [r["line_end"] for r in e.chunks("p", "a.log").collect()] == [60]
    write(root, {".index.toml": '[plugins]\nenable = ["logs"]\n', "a.log": "line\n" * 61})
    e.index("p")
    assert [r["line_end"] for r in e.chunks("p", "a.log").collect()][0] == 20


def test_push(spark, tmp_path):
    now = [1000.0]
    e = Engine(spark, f"file://{tmp_path}/store", clock=lambda: now[0])
    e.add("/remote", "R")
    files = {"a.txt": b"alpha text", "b/c.md": b"# C\nbody text of c\n"}

    def manifest(fs):
        entries = [(p, hashlib.sha256(c).hexdigest(), len(c)) for p, c in fs.items()]
        lines = "\n".join("\0".join(map(str, x)) for x in sorted(entries))
        return entries, hashlib.sha256(lines.encode()).hexdigest()

    s = e.lease("r")
    entries, checksum = manifest(files)
    with pytest.raises(ValueError):
        e.push_manifest(s, entries, "0" * 64)
    with pytest.raises(ValueError):
        e.push_manifest(s, [("../x", "h", 1)], checksum)
    assert e.push_manifest(s, entries, checksum) == (["a.txt", "b/c.md"], 0)
    with pytest.raises(ValueError):
        e.push_commit(s)
    with pytest.raises(ValueError):
        e.push_file(s, "a.txt", b"other text")
    for p, c in files.items():
        e.push_file(s, p, c)
    assert e.push_commit(s) == {"new": 2} and e.store.table("chunks").count() == 2
    with pytest.raises(ValueError):
        e.push_manifest(s, entries, checksum)  # too soon
    now[0] += 20
    later = {"a.txt": b"alpha text", "d.txt": b"delta"}
    assert e.push_manifest(s, *manifest(later)) == (["d.txt"], 1)
    e.push_file(s, "d.txt", b"delta")
    assert e.push_commit(s) == {"deleted": 1, "new": 1, "unchanged": 1}
    t = e.lease("r")
    with pytest.raises(StaleWriter):
        e.push_commit(s)
    now[0] += 31
    with pytest.raises(StaleWriter):
        e.renew(t)


def test_a_pass_writes_its_own_project_alone(spark, tmp_path, monkeypatch):
    from tesserine.sources import store as S

    for name, text in (("one", "leases in one\n"), ("two", "leases in two\n"), ("three", "leases in three\n")):
        write(tmp_path / name, {"a.txt": text, "b.txt": f"more of {name}\n"})
    e = Engine(spark, f"file://{tmp_path}/store")
    ids = [e.add(str(tmp_path / n), n.title()) for n in ("one", "two", "three")]
    for n in ("one", "two", "three"):
        e.index(n)
    paths = lambda query: sorted((r["project_id"], r["path"]) for r in e.search(query)[0].collect())
    assert paths("leases") == [(i, "a.txt") for i in ids]
    before = e.store.current().tables
    write(tmp_path / "one", {"a.txt": "claims in one\n"})
    assert e.index("one")["changed"] == 1
    after = e.store.current().tables
    assert all(after[t][str(i)] == before[t][str(i)] for t in ("files", "chunks") for i in ids[1:]) and after["chunks"][str(ids[0])] != before["chunks"][str(ids[0])]
    # The full-text index follows, by the postings of what came and went.
    monkeypatch.setattr("tesserine.operators.search.postings", lambda chunks, real=__import__("tesserine.operators.search", fromlist=["x"]).postings: real(chunks.where("text like '%claims%'")))
    assert paths("leases") == [(i, "a.txt") for i in ids[1:]] and paths("claims") == [(ids[0], "a.txt")] and paths("more") == [(i, "b.txt") for i in ids]
    # Vectors are added to the parts; a part of many additions is written anew.
    monkeypatch.setattr(S, "MAX_ADDITIONS", 2)
    space = {"model": "m", "dims": 2}
    counts = [e.embed(lambda texts: [[float(len(t)), 1.0] for t in texts], space, page=1)[0] for _ in range(7)]
    assert counts == [1] * 6 + [0] and e.store.table("chunk_vectors").count() == 6
    assert all(len(p) <= 2 for p in e.store.current().tables["chunk_vectors"].values())
    e.remove("two")
    left = e.store.current()
    assert all(str(ids[1]) not in left.tables[t] for t in ("files", "chunks", "chunk_vectors")) and left.tables["chunks"][str(ids[2])] == before["chunks"][str(ids[2])]
    assert e.store.table("chunk_vectors").count() == 4


def test_lost_events_reach_all_projects(spark, tmp_path):
    for n in ("one", "two"):
        write(tmp_path / n, {"a.txt": f"text of {n}\n"})
    e = Engine(spark, f"file://{tmp_path}/store")
    ids = [e.add(str(tmp_path / n), n) for n in ("one", "two")]
    work = C.coalesce(C.route(spark.createDataFrame([(None, None, "rescan", None), (ids[0], "a.txt", "modify", None)], C.EVENT_FIELDS)))
    e.handle_changes(spark, work, 0)
    assert e.store.table("files").count() == 2
