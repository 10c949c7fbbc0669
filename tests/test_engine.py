"""Search, chunking, authority, evaluation: scenarios with hand-made rows."""

import json
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.functions import vectors as V
from tesserine.operators import authority as A
from tesserine.operators import chunking as C
from tesserine.operators import evaluation as E
from tesserine.operators import indexing as I
from tesserine.operators import search as S
from tesserine.operators.filters import SearchFilter, filter_chunks, nearest_root, request_filter, resolve_project

CHUNK = "id long, project_id long, chunk_id string, path string, anchor string, kind string, language string, line_start int, line_end int, text string, design_status string, effective_tier int, demotion string, vault string"
PROJECT = "id long, root string, name string, project_key string, kind string, authority_profile string, authority_behavior string"


def chunk(i, text, path=None, project=1, language="rust", status=None, tier=1, kind=None, anchor=None):
    path = path or f"src/f{i}.rs"
    return (i, project, f"{i:064x}", path, anchor or f"code:f{i}", json.dumps(kind or {"kind": "code", "symbol_kind": "function", "symbol_path": f"f{i}"}), language, 1, 2, text, status, tier, None, None)


def chunks_of(spark, rows):
    return spark.createDataFrame(rows, CHUNK)


@pytest.fixture(scope="module")
def projects(spark):
    rows = [(1, "/a", "Alpha", "alpha", "repo", "lore-v1", "rank"), (2, "/a/b", "beta", "alpha-2", "session", None, None), (3, "/ab", "77", "2", "odd", None, None)]
    return spark.createDataFrame(rows, PROJECT)


# --- text


def terms(q):
    return [t.text + "*" * t.prefix for t in T.query_terms(q)]


def test_query_terms():
    assert terms("Board.Update") == ["board", "update"] and terms("a AND (") == ["a"] and terms("NEAR(a b, 3)") == ["a", "b", "3"]
    assert terms("*") == terms(")))") == terms("  ") == [] and len(terms("x " * 200)) == 64
    assert terms("content_ha* and Été") == ["content_ha*", "and", "ete"]


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_text_expressions(spark):
    lit = F.lit
    assert one(spark, T.tokens(lit("Été foo_bar, x2!")))[0] == ["ete", "foo_bar", "x2"]
    assert one(spark, T.decision_refs(lit("D-0001, xD-0002 D-00033 D-0004_ (D-0005) D-0001")))[0] == ["D-0001", "D-0005"]
    assert one(spark, T.slug(lit("  Héllo, World! ")), T.slug(lit("!!")), T.slug(lit("a" * 60))) == ("h-llo-world", "project", "a" * 40)
    assert one(spark, T.strip_discriminators(lit("A.b#w1#d2")), T.strip_discriminators(lit("A.#s0")), T.display_symbol(lit("A#d1"))) == ("A.b", "A", "A#d1")
    assert one(spark, T.truncate_utf8(lit("aé€"), lit(3)), T.truncate_utf8(lit("aé€"), lit(2)), T.truncate_utf8(lit(None).cast("string"), lit(2))) == ("aé", "a", None)
    assert one(spark, T.is_within(lit("/ab"), lit("/a")), T.is_within(lit("/a/b"), lit("/a")), T.relative_to(lit("/a/b/c"), lit("/a")), T.relative_to(lit("/x"), lit("/a"))) == (False, True, "b/c", None)
    assert one(spark, T.expand_lines(lit("1\n2\n3\n4\n5"), lit(3), lit(3), 1), T.expand_lines(lit("1\n2"), lit(1), lit(9), 5)) == ("2\n3\n4", "1\n2")
    assert one(spark, T.is_id_prefix(lit("ABCDEF01")), T.is_id_prefix(lit("abc")), T.is_git_metadata(lit("a/.GIT/b"))) == (True, False, True)
    header = T.embed_text(lit("rust"), lit("a.rs"), T.anchor_phrase(lit("code"), lit("X.y#w2"), F.array(lit("q"))), lit("body"), "doc: ")
    assert one(spark, header) == ("doc: rust a.rs X.y\nbody",)
    bad = {"": "empty", "a\\b": "backslash", "/a": "absolute", "C:x": "drive letter", "a//b": "empty component", "a/": "empty component", "a/../b": "parent component", "a/.Git/b": "git metadata"}
    good = ["a", "a/b.c", ".gitignore", "a..b", "x/.github/y", "ab:c"]
    df = spark.createDataFrame([(p,) for p in [*bad, *good]], "p string")
    assert dict(df.select("p", T.malformed_path(F.col("p"))).collect()) == bad | dict.fromkeys(good)


def test_vectors(spark):
    rows = [[3.0, 4.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [], None, [1e-8, 0.0], [None, 1.0]]
    df = spark.createDataFrame([(v,) for v in rows], "v array<float>")
    assert [r[0] for r in df.select(V.usable(F.col("v"))).collect()] == [True] + [False] * 7
    assert df.select(V.normalise(F.col("v"))).first()[0] == pytest.approx([0.6, 0.8])


# --- search


def bm25(rows, query):
    """The published formula, over dictionaries."""
    toks = {r[0]: {c: re.findall(r"\w+", (r[i] or "").lower()) for c, i in (("text", 9), ("path", 3), ("anchor", 4))} for r in rows}
    length = {i: sum(map(len, t.values())) for i, t in toks.items()}
    mean = sum(length.values()) / len(length)
    out = {}
    for t in T.query_terms(query):
        w = {i: sum(S.WEIGHTS[c] * sum(x.startswith(t.text) if t.prefix else x == t.text for x in xs) for c, xs in d.items()) for i, d in toks.items()}
        n = sum(v > 0 for v in w.values())
        idf = math.log((len(rows) - n + 0.5) / (n + 0.5))
        idf = idf if idf > 0 else 1e-6
        for i, v in w.items():
            if v:
                hits, s = out.get(i, (0, 0.0))
                out[i] = hits + 1, s + idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * length[i] / mean))
    k = len(T.query_terms(query))
    full = {i: s for i, (h, s) in out.items() if h == k}
    return full or {i: s for i, (h, s) in out.items()}


def test_bm25_and_fallback(spark):
    rows = [chunk(1, "handshake heartbeat keeps the lease"), chunk(2, "handshake only"), chunk(3, "heartbeat only heartbeat"), chunk(4, "nothing"), chunk(5, None, path="handshake/x.rs", anchor="code:Handshake")]
    df = chunks_of(spark, rows)
    for q in ("handshake heartbeat", "handshake", "hand* keep*", "lease absent", "absent", "handshake handshake"):
        got = {r["id"]: r["score"] for r in S.lexical(df, q).collect()}
        assert got == pytest.approx({i: round(s, 9) for i, s in bm25(rows, q).items()})
    assert S.lexical(df, " ) ( ").count() == 0 and S.lexical(df.limit(0), "handshake").count() == 0
    ranked = S.lexical(df, "heartbeat").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2] and ranked[0]["score"] >= ranked[1]["score"]


def test_index_maintenance(spark):
    rows = [chunk(i, f"alpha w{i} w{i}") for i in range(4)]
    index = S.postings(chunks_of(spark, rows[:3]))
    after = S.maintain_postings(index, chunks_of(spark, rows[3:]), chunks_of(spark, rows[:1]))
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, S.postings(chunks_of(spark, rows[1:])).collect()))


def test_statistics_ignore_the_filter(spark):
    rows = [chunk(i, "wombat " * (i % 3 + 1), language="rust" if i % 2 else "csharp") for i in range(1, 9)]
    df = chunks_of(spark, rows)
    all_scores = {r["id"]: r["score"] for r in S.lexical(df, "wombat").collect()}
    some = {r["id"]: r["score"] for r in S.lexical(df, "wombat", SearchFilter(language="rust")).collect()}
    assert some == {i: s for i, s in all_scores.items() if i % 2}
    # The conjunction is judged after the filter: the only full match lies outside of it.
    rows = [chunk(1, "alpha beta", language="csharp"), chunk(2, "alpha"), chunk(3, "beta")]
    assert {r["id"] for r in S.lexical(chunks_of(spark, rows), "alpha beta", SearchFilter(language="rust")).collect()} == {2, 3}


def test_filters(spark, projects):
    rows = [
        chunk(1, "wombat", language="csharp"), chunk(2, "wombat"), chunk(3, "wombat", project=2), chunk(4, "wombat", path="design/a.md", language="markdown", status="decided", tier=3),
        chunk(5, "wombat", path="design/99_Scratch/b.md", language="markdown", status="deprecated", tier=0), chunk(6, "wombat", path="docs/c.md", language="markdown"), chunk(7, "x", project=3),
    ]
    df = chunks_of(spark, rows)
    ids = lambda f: {r["id"] for r in filter_chunks(df, f, projects).collect()}
    assert ids(SearchFilter()) == set(range(1, 8)) and ids(SearchFilter(project_id=1)) == {1, 2, 4, 5, 6}
    assert ids(request_filter(path_prefix="design\\")) == {4, 5} and ids(request_filter(language="RUST")) == {2, 3, 7} and ids(SearchFilter(path_prefix="d%")) == set()
    assert ids(SearchFilter(statuses=())) == set() and ids(request_filter(statuses=[])) == set(range(1, 8))
    assert ids(SearchFilter(statuses=("decided",))) == {4} and ids(SearchFilter(statuses=("decided", "unclassified"))) == {1, 2, 3, 4, 6, 7}
    assert ids(SearchFilter(sources=("session",))) == {3} and ids(SearchFilter(sources=("repo",))) == {1, 2, 4, 5, 6, 7} and ids(SearchFilter(sources=())) == set()
    assert ids(SearchFilter(min_authority=1)) == {1, 2, 3, 4, 6, 7}
    for bad in ({"statuses": ("x",)}, {"sources": ("x",)}):
        with pytest.raises(ValueError):
            SearchFilter(**bad)
    assert [resolve_project(projects, x) for x in ("alpha", "BETA", "1", "77", "2")] == [1, 2, 1, 3, 3]
    with pytest.raises(ValueError):
        resolve_project(projects, "nope")
    paths = spark.createDataFrame([("/a/x",), ("/a/b",), ("/a/b/c",), ("/ab/c",), ("/abc",)], "path string")
    assert dict(nearest_root(projects, paths).collect()) == {"/a/x": 1, "/a/b": 2, "/a/b/c": 2, "/ab/c": 3}


def test_agreement_beats_depth(spark, projects):
    """A chunk at rank 51 of both arms beats one that leads a single arm."""
    rows = [chunk(i, "needle " * (60 - i) + "pad " * i) for i in range(50)] + [chunk(100 + i, "opaque words") for i in range(50)] + [chunk(200, "needle " + "pad " * 300)]
    cos = lambda c: [c, math.sqrt(1 - c * c), 0.0, 0.0]
    vectors = spark.createDataFrame([(100 + i, cos(0.99 - 0.001 * i)) for i in range(50)] + [(200, cos(0.5))], "chunk_rowid long, vector array<float>")
    neutral = projects.withColumn("authority_behavior", F.lit("off"))
    df = chunks_of(spark, rows)
    lex = {r["id"]: r["rank"] for r in S.lexical(df, "needle").collect()}
    assert lex[200] == 51
    page, flag = S.search(df, neutral, "needle", vectors, [1.0, 0.0, 0.0, 0.0])
    top = page.orderBy("rank").first()
    assert top["chunk_id"] == f"{200:064x}" and top["score"] == pytest.approx(2 / 111) and not flag.first()[0]
    assert S.search(df, neutral, "needle")[1].first()[0] and S.search(df, neutral, "needle", vectors, [0.0] * 4)[1].first()[0]
    assert S.vector(df, vectors, [1.0, 0.0]).count() == 0  # another width


def test_rrf_and_authority(spark, projects):
    arm = lambda ids: spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "id long, rank int")
    got = {r["id"]: r["rrf"] for r in S.fuse(arm([1, 2]), arm([3, 2])).collect()}
    assert got == pytest.approx({2: 2 / 62, 1: 1 / 61, 3: 1 / 61})
    rows = [chunk(1, "x", tier=0), chunk(2, "x", tier=3), chunk(3, "x", project=2, tier=3)]
    page = S.rank_rows(S.fuse(arm([1, 2, 3])), chunks_of(spark, rows), projects).orderBy("rank").collect()
    assert [r["id"] for r in page] == [2, 3, 1] and page[0]["score"] == pytest.approx(1.07 / 62)
    shown = {r["rank"]: r["authority"] for r in S.result_rows(S.rank_rows(S.fuse(arm([1, 2, 3])), chunks_of(spark, rows), projects)).collect()}
    assert shown == {1: 3, 2: None, 3: 0}


def test_windows_collapse_and_the_page_refills(spark, projects):
    kind = lambda f, i: {"kind": "code", "symbol_kind": "function", "symbol_path": f"Big#w{i}", "window": {"family": f, "index": i}}
    rows = [chunk(i, "needle needle needle", path="big.rs", kind=kind(0, i)) for i in range(60)] + [chunk(100 + i, "needle " + "pad " * (9 + i)) for i in range(25)]
    rows += [chunk(200, "needle needle needle", path="big.rs", kind=kind(1, 0))]
    page = S.search(chunks_of(spark, rows), projects, "needle", limit=10)[0].collect()
    assert len(page) == 10 and sum(r["path"] == "big.rs" for r in page) == 2  # two families
    assert S.search(chunks_of(spark, rows), projects, "needle", limit=1000)[0].count() == 27


def test_lookup_and_backlog(spark):
    rows = [chunk(1, "a"), chunk(2, "b"), chunk(2, "b"), chunk(300, "c")]
    df = chunks_of(spark, rows)
    assert S.lookup(df, 1, f"{1:064x}")[0] == "found" and S.lookup(df, 1, "f")[0] == "unknown" and S.lookup(df, 2, "0")[0] == "unknown"
    kind, hits = S.lookup(df, 1, "0" * 8, cap=2)
    assert kind == "ambiguous" and len(hits) == 2
    vectors = spark.createDataFrame([(1, None)], "chunk_rowid long, vector array<float>")
    assert [r["id"] for r in S.backlog(df, vectors).collect()] == [2, 300] and [r["id"] for r in S.backlog(df, vectors, after=2, page=1).collect()] == [300]


# --- chunking


def cut(path, text, **kw):
    return C.chunk_file(path, text if isinstance(text, bytes) else text.encode(), **kw)


def check_invariants(path, src, rows):
    data = src.encode()
    ids = [r[0] for r in rows]
    assert len(set(ids)) == len(ids)
    for key, p, anchor, kind, lang, a, b, l1, l2, text, *_ in rows:
        assert data[a:b].decode() == text and text.strip() == text and text
        assert l1 == data[:a].count(b"\n") + 1 and l2 == data[: b - 1].count(b"\n") + 1
        assert key == C.content_id(p, anchor, text)


def test_log_windows():
    src = "".join(f"line {i}\n" for i in range(1, 189))
    rows, why = cut("a.log", src)
    assert why is None and [(r[7], r[8]) for r in rows] == [(1, 80), (71, 150), (141, 188)] and [r[2] for r in rows] == ["win:0", "win:1", "win:2"]
    check_invariants("a.log", src, rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=60), st.integers(1, 12), st.integers(10, 90), st.integers(0, 11))
def test_window_geometry(lengths, lines, max_bytes, overlap):
    src = "\n".join("x" * n for n in lengths).encode()
    index = C.Lines(src)
    got = list(index.windows(1, index.count, lines, max_bytes, overlap))
    assert got[0][0] == 1 and got[-1][1] == index.count
    for a, b in got:
        assert a <= b and b - a < lines and (a == b or index.finish(b) - index.begin(a) <= max_bytes)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert c > a and c <= b + 1 and (c == b + 1 - overlap or c == a + 1)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("# ab\n`~-D0123é\t\r{};/\"'"), max_size=400), st.sampled_from(["a.md", "a.txt", "a.rs", "a.cs", "a.js", "a.py"]))
def test_chunk_invariants(src, path):
    rows, _ = cut(path, src, vault_profile=True)
    check_invariants(path, src, rows)


def test_markdown():
    src = "﻿---\ndesign_status: Leaning\ndecision_refs:\n  - D-0001\n  - [[D-0002]]\nother: [x]\n---\npreamble text\n# Learning C#\n\n## Wrap ###\nlong enough intro to stand alone here\n### Deep\nsee D-0007 and D-0007\n```\n# not a heading\n```\n# Tiny\nhi\n## Child\nbody\n"
    rows, _ = cut("n.md", src, vault_profile=True)
    check_invariants("n.md", src, rows)
    assert [r[2] for r in rows] == ["md:", "md:Learning C# > Wrap", "md:Learning C# > Wrap > Deep", "md:Tiny > Child"]
    assert json.loads(rows[2][10]) == {"design_status": "leaning", "decision_refs": ["D-0001", "D-0002"], "body_decision_refs": ["D-0007"]}
    assert rows[0][11] == "leaning" and rows[0][12] == 2 and rows[3][9].startswith("hi") and "# not a heading" in rows[2][9]
    plain, _ = cut("n.md", src)
    assert [r[0] for r in plain] == [r[0] for r in rows] and plain[0][10] is None and plain[0][12] == 1
    assert cut("u.md", "---\ndesign_status: decided\nno end\n", vault_profile=True)[0][0][11] is None
    assert [C.heading_title(x) for x in (" A ##", " ###", " C#", " a # b #", "")] == ["A", "", "C#", "a # b", ""]


def test_oversize_sections_form_families():
    src = "# Big\n" + "word " * 12 + "\n" + ("some line of text here\n" * 400) + "# Big\n" + ("some line of text here\n" * 400)
    rows, _ = cut("b.md", src)
    check_invariants("b.md", src, rows)
    families = [json.loads(r[3])["window"]["family"] for r in rows]
    assert set(families) == {0, 1} and all(r[6] - r[5] <= C.MAX_CHUNK_BYTES for r in rows) and rows[0][2] == "md:Big > #w0"


def test_python_code():
    src = '"""Doc."""\nimport os\n\n# about f\n@deco\ndef f(x):\n    return x\n\n\nclass Big:\n    """Many members."""\n\n' + "".join(f"    def m{i}(self):\n        " + "x = 1; " * 40 + "\n\n" for i in range(8)) + "y = f(1)\n"
    rows, _ = cut("m.py", src)
    check_invariants("m.py", src, rows)
    anchors = [r[2] for r in rows]
    assert "code:Big" in anchors and "code:Big.m3" in anchors and any("# about f\n@deco" in r[9] for r in rows)
    assert sum(len(r[9]) for r in rows) >= len(re.sub(r"\s+", "", src)) * 0.9
    assert cut("bad.py", "def (:\n")[0][0][2] == "win:0"  # falls back to windows, with its language
    assert cut("bad.py", "def (:\n")[0][0][4] == "python"


def test_brace_code():
    rust = "use a::b;\n\n/// Docs.\n#[derive(Debug)]\npub struct S { x: u8 }\n\nimpl Tr for S {\n" + "".join(f"    fn m{i}(&self) -> u8 {{ let c = '}}'; let s = \"}}\"; /* }} */ self.x + {i} }}\n" + "    // pad " + "z" * 220 + "\n" for i in range(6)) + "}\nfn free() { if x { y } }\n"
    rows, _ = cut("a.rs", rust)
    check_invariants("a.rs", rust, rows)
    anchors = [r[2] for r in rows]
    assert any(a.startswith("code:S#Tr") for a in anchors) and any("m3" in a for a in anchors)
    assert cut("a.rs", "fn a() { {\n")[0][0][2] == "win:0"
    js, _ = cut("a.jsx", "export class A {\n" + "".join(f"  go{i}(x) {{ return `}}${{x}}`; }}\n  // {'p' * 230}\n" for i in range(6)) + "}\nconst f = (x) => { return x; };\n")
    assert any("code:A" == r[2] for r in js) and any(r[2].startswith("code:A.go") for r in js)


def test_skips(spark):
    assert cut("a.bin", b"a\0b")[1] == "binary" and cut("a.txt", b"\xff\xfe")[1] == "invalid utf-8"
    assert cut("a.txt", "x" * 5000)[1] == "machine text" and cut("a.md", "x" * 5000)[1] is None
    assert cut("a.txt", b"a" * (C.MAX_FILE_BYTES + 1))[1] == "too large" and cut("e.txt", "")[0] == [] and cut("e.txt", " \n ")[0] == []
    rows = [("a.bin", b"a\0b"), ("b.txt", b"\xff"), ("c.txt", b"y" * 5000), ("d.md", b"y" * 5000), ("e.txt", b"ok"), ("f.txt", None)]
    df = spark.createDataFrame([(1, p, c) for p, c in rows], "project_id long, path string, content binary")
    assert {r["path"]: r["reason"] for r in C.skipped_files(df).collect()} == {"a.bin": "binary", "b.txt": "invalid utf-8", "c.txt": "machine text"}
    assert {r["path"] for r in C.chunk_files(df).collect()} == {"d.md", "e.txt"}


def test_plugins():
    a, b = C.Plugin("a", ("log", "rs", "x"), lines=20, overlap=50), C.Plugin("b", ("x",))
    assert C.claims([a, b]) == {"log": a}
    rows, _ = cut("a.log", "l\n" * 60, plugins=(a, b))
    assert [(r[7], r[8]) for r in rows][:2] == [(1, 20), (11, 30)]
    assert C.Windows().tightened(500, 50) == C.Windows()


# --- authority


def test_tiers(spark):
    none = F.array().cast("array<string>")

    def tier(path, status=None, refs=(), kind="repo", on=True):
        r = F.array(*map(F.lit, refs)) if refs else none
        return tuple(spark.range(1).select(A.effective(F.lit(path), F.lit(status), r, F.array(F.lit("D-0001")), F.lit(kind), F.lit(on)).alias("v")).select("v.*").first())

    assert tier("a.md", "decided", ("D-0009", "D-0001")) == (3, None) and tier("a.md", "decided", ("D-0002",)) == (1, "uncited_decided")
    assert tier("a.md", "decided") == (1, "uncited_decided") and tier("a.md", "leaning") == (2, None) and tier("a.md") == (1, None) and tier("a.md", "deprecated") == (0, None)
    assert tier("d/99_Scratch/a.md", "decided") == (0, "uncited_decided") and tier("99_Scratch/a.md", "leaning") == (0, "scratch_path") and tier("99_Scratch/a.md", "deprecated") == (0, None)
    assert tier("7_Research/a.md", "leaning") == (1, "research_path") and tier("7_Research/a.md") == (1, None) and tier("7_Research/99_Scratch/a.md", "leaning")[0] == 0
    assert tier("a.md", "leaning", kind="session") == (1, "session_source") and tier("a.md", kind="session") == (1, None)
    assert tier("a.md", "decided", on=False) == (1, None) and tier("99_Scratch/a.md", "decided", kind="session", on=False) == (1, "session_source")
    assert tier("x/0_Canon/DECISIONS.md", "deprecated") == (3, None) and tier("0_Canon/decisions/D-0012-a.md") == (3, None) and tier("0_Canon/decisions/D-0012.md") == (1, None)


def test_recompute_touches_only_what_changes(spark, projects):
    rows = [chunk(1, "x", path="a.md", status="decided", tier=3), chunk(2, "x", path="b.md", status="leaning", tier=2), chunk(3, "x", project=2, tier=1)]
    got = {r["id"]: (r["tier"], r["demotion"], r["changed"]) for r in A.recompute(chunks_of(spark, rows), projects, spark.createDataFrame([], "project_id long, id string")).collect()}
    assert got == {1: (1, "uncited_decided", True), 2: (2, None, False), 3: (1, "session_source", True)}
    summary = A.recompute_summary(A.recompute(chunks_of(spark, rows), projects, spark.createDataFrame([], "project_id long, id string"))).first()
    assert tuple(summary) == (3, 2, 2, 1)


def test_supersession_lists(spark):
    cases = {"D-0001.": ["D-0001"], "D-0001, D-0002 and [[D-0003]]": ["D-0001", "D-0002", "D-0003"], "D-0002's first clause": [], "None (extends D-0015)": [], "**D-0001** & D-0002;": ["D-0001", "D-0002"], "": []}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert dict(df.select("v", A.bare_ids(F.col("v"))).collect()) == cases


def test_namespaces(spark):
    rows = [(1, "a/0_Canon/DECISIONS.md"), (1, "b/0_Canon/decisions/D-0001-x.md"), (2, "0_Canon/DECISIONS.md"), (2, "0_Canon/decisions/D-0002-y.md"), (2, "other.md")]
    got = [tuple(r) for r in A.namespace_warnings(spark.createDataFrame(rows, "project_id long, path string")).collect()]
    assert got == [(1, "b/0_Canon", "a/0_Canon")]


# --- indexing


def files_of(spark, rows):
    return spark.createDataFrame([(1, p, h) for p, h in rows], "project_id long, path string, content_hash string")


def test_diff(spark):
    stored, seen = files_of(spark, [("a", "1"), ("b", "1"), ("c", "1"), ("d/e", "1"), ("u", "1")]), files_of(spark, [("a", "1"), ("b", "2"), ("n", "1")])
    state = lambda **k: {r["path"]: r["state"] for r in I.classify(seen, stored, **k).collect()}
    bad = spark.createDataFrame([(1, "u")], "project_id long, path string")
    assert state(unreadable=bad) == {"a": "unchanged", "b": "changed", "c": "deleted", "d/e": "deleted", "n": "new", "u": "unreadable"}
    scope = spark.createDataFrame([(1, "d"), (1, "n")], "project_id long, scope string")
    assert {p for p, s in state(scope=scope).items() if s == "deleted"} == {"d/e"}
    assert I.pass_summary(I.classify(seen, stored)).first()["n_deleted"] == 3


@pytest.mark.parametrize("deletes,total,refused", [(100, 150, False), (101, 202, False), (101, 201, True), (300, 300, True), (3, 3, False)])
def test_guard(spark, deletes, total, refused):
    stored = files_of(spark, [(f"f{i}", "1") for i in range(total)])
    diff = I.classify(stored.where(F.substring("path", 2, 9).cast("int") >= deletes), stored)
    g = I.guard(diff, stored)
    assert tuple(g.first()) == (1, deletes, total, refused)
    assert I.admitted(diff, g).isEmpty() == refused and not I.admitted(diff, g, override=True).isEmpty()


def test_replace_chunks(spark):
    row = "project_id long, path string, chunk_id string, id long"
    stored = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2), (1, "b", "z", 3)], row)
    incoming = spark.createDataFrame([(1, "a", "y", None), (1, "a", "w", 9)], row)
    w = I.replace_chunks(stored, incoming, stored.where("path = 'a'"))
    assert sorted((r["chunk_id"], r["id"]) for r in w.table.collect()) == [("w", 9), ("y", 2), ("z", 3)]
    assert [df.count() for df in (w.inserted, w.kept, w.deleted)] == [1, 1, 1]
    with pytest.raises(ValueError):
        I.replace_chunks(stored, incoming, stored.where("path = 'b'"))


def test_push(spark):
    m = spark.createDataFrame([(1, "a", "h1", 3), (1, "b", "h2", 4), (2, "../x", "h", 1), (2, "y", "h", 1)], "project_id long, path string, content_hash string, size_bytes long")
    assert sorted(tuple(r) for r in I.negotiate(m, files_of(spark, [("a", "h1")])).collect()) == [(1, "a", "h1", False), (1, "b", "h2", True)]
    assert I.malformed(m).first()["reason"] == "parent component"
    a, b = I.manifest_checksum(m).collect(), I.manifest_checksum(m.orderBy(F.desc("path"))).collect()
    assert dict(a) == dict(b) and len(a) == 2
    assert I.declared_mounts([("x/y", "m"), ("z", "n")]) and I.locate("/r/x/f", [("/r", None), ("/r/x", "m")]) == "m/f" and I.locate("/q", [("/r", None)]) is None
    for bad in ([("/x", "m")], [("x", "a/b")], [("x", "m"), ("y", "M")], [("x", "m"), ("x/y", "n")], [("../x", "m")]):
        with pytest.raises(ValueError):
            I.declared_mounts(bad)


def test_vector_sink(spark):
    v = "chunk_rowid long, project_id long, dims int, vector array<float>"
    stored = spark.createDataFrame([(1, 1, 2, [1.0, 0.0]), (2, 1, 2, [0.0, 1.0])], v)
    chunks = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    new = spark.createDataFrame([(2, 1, 2, [1.0, 1.0]), (3, 1, 2, [1.0, 0.0]), (9, 1, 2, [1.0, 0.0])], v)
    assert {r["chunk_rowid"]: r["vector"] for r in I.store_vectors(stored, new, chunks).collect()} == {1: [1, 0], 2: [1, 1], 3: [1, 0]}
    with pytest.raises(ValueError):
        I.store_vectors(stored, spark.createDataFrame([(3, 1, 2, [0.0, 0.0])], v), chunks)


# --- evaluation


def test_metrics(spark):
    runs = spark.createDataFrame([("m", 1, 1, 1, "A.rs"), ("m", 1, 1, 2, "x"), ("m", 1, 1, 3, "a.RS"), ("m", 1, 1, 4, "b"), ("m", 1, 2, 1, "q"), ("m", 0, 2, 1, "hit")], "model string, run_set int, query_id long, rank int, path string")
    keys = spark.createDataFrame([(1, "k", "a.rs"), (1, "k", "b"), (2, "k", "hit"), (3, "j", "z")], "query_id long, kind string, path string")
    got = {r["query_id"]: r for r in E.key_metrics(E.latest_runs(runs), keys).collect()}
    assert got[1]["first_rank"] == 1 and got[1]["ndcg10"] == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3))) and got[2]["hit10"] == got[3]["hit5"] == 0
    labels = spark.createDataFrame([(1, "a.rs", 2, 1), (1, "b", 0, 1), (1, "b", 1, 2), (1, "x", 0, 1)], "query_id long, path string, label int, at int")
    j = {r["query_id"]: r for r in E.judged_metrics(E.latest_runs(runs), labels).collect()}
    assert j[1]["p5"] == pytest.approx(2 / 3) and j[1]["strict_p5"] == pytest.approx(1 / 3) and j[1]["coverage"] == 1 and j[2]["p5"] is None
    assert j[1]["graded_ndcg"] == pytest.approx((2 + 1 / 2) / (2 + 1 / math.log2(3)))
    assert tuple(E.calibration(keys, labels).first()) == (2, 2, 1)
    assert {r["query_id"] for r in E.offenders(E.key_metrics(E.latest_runs(runs), keys), E.judged_metrics(E.latest_runs(runs), labels)).collect()} == {2, 3}
    hashes = spark.createDataFrame([("a.rs", "h"), ("b", "h")], "path string, content_hash string")
    done = spark.createDataFrame([(1, "a.rs", "h"), (1, "b", "old")], "query_id long, path string, content_hash string")
    assert [tuple(r) for r in E.judging_pool(runs, done, hashes).collect()] == [(1, "b", "h")]


def test_stored_index_answers_as_the_scan_does(spark, sf, tmp_path):
    from tesserine.operators import search as S
    from tesserine.operators.filters import SearchFilter

    chunks = spark.read.parquet(f"{sf}/chunks.parquet").dropDuplicates(["id"])
    old = chunks.where("id % 3 <> 0")
    S.write_index(S.postings(old), old, f"file://{tmp_path}/a")
    # The index after a pass: some chunks go, some come.
    new = chunks.where("id % 5 <> 0")
    entries = S.maintain_postings(S.read_index(spark, f"file://{tmp_path}/a").postings.drop("bucket"), new.where("id % 3 = 0"), old.where("id % 5 = 0"))
    S.write_index(entries, new, f"file://{tmp_path}/b")
    index = S.read_index(spark, f"file://{tmp_path}/b")
    for query in ("index snapshot", "zzqx snapshot", "snap* the", "s* index", "the the", "ÍNDEX", "", "* AND"):
        for f in (SearchFilter(), SearchFilter(language="rust")):
            scan = [tuple(r) for r in S.lexical(new, query, f).orderBy("rank").collect()]
            assert [tuple(r) for r in S.lexical(new, query, f, index=index).orderBy("rank").collect()] == scan
    plan = S.lexical(new, "index", index=index)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "PartitionFilters: [isnotnull(bucket" in plan


def test_scanner_steps_over_literals():
    from tesserine.operators.chunking import brace_items

    names = lambda src, lang: None if (x := brace_items(src, lang)) is None else [i.name for i in x]
    js = [b"fetch('https://x.org/a'); }", b"const r = /[{\\/]+/g; }", b"return a / b / c; }", b"x = `a ${ {k: `}`}.k } {`; }", b"if (/}/.test(s)) { y() } }", b'z = "}"; }', b"/* } */ // }\n }", b"w = 'it\\'s }'; }"]
    for body in js:
        assert names(b"function one() { " + body + b"\nfunction two(a) { return a; }\n", "javascript") == ["one", "two"], body
        assert names(b"function one() { " + body + b"\nfunction two(a) { return a; }\n", "typescript") == ["one", "two"]
    rust = [b'let s = r#"a " } {"#; }', b"let c = '}'; }", b"fn_of::<'a>(x) }", b'let s = "a\n}"; }', b"/* a /* } */ } */ }", b"let b = br\"}\"; }", b"let q = '\\''; }", b"let u = '\\u{7d}'; }"]
    for body in rust:
        assert names(b"fn one() { " + body + b"\npub fn two() -> u8 { 1 }\n", "rust") == ["one", "two"], body
    sharp = [b'var s = @"c:\\"; }', b'var s = @"a "" }"; }', b"var c = '}'; }", b'var s = """ } " {""" ; }', b'var s = $"{x}"; }', b'var s = $@"}}{x}"; }']
    for body in sharp:
        (cls,) = brace_items(b"public class C {\n void One() { " + body + b"\n public int Two(int a) { return a; }\n}\n", "csharp")
        assert [m.name for m in cls.members] == ["One", "Two"], body
    assert names(b"function broken() { {", "javascript") is None


def test_a_failing_vector_arm_leaves_the_words(spark, sf, monkeypatch):
    from tesserine.operators import search as S

    chunks, projects = spark.read.parquet(f"{sf}/chunks.parquet"), spark.read.parquet(f"{sf}/projects.parquet")

    def broken(*_, **__):
        raise RuntimeError("no vectors today")

    words = S.search(chunks, projects, "index snapshot", limit=20)
    monkeypatch.setattr(S, "vector", broken)
    rows, flags = S.search(chunks, projects, "index snapshot", spark.read.parquet(f"{sf}/chunk_vectors.parquet"), [1.0] * 64, limit=20)
    assert flags.first()["lexical_only"] and [r["chunk_id"] for r in rows.collect()] == [r["chunk_id"] for r in words[0].collect()]
    monkeypatch.setattr(S, "DEPTH", 1)
    assert S.search(chunks, projects, "s*")[1].first()["at_depth"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=40, unique=True), st.lists(st.integers(0, 40), max_size=40, unique=True), st.integers(1, 8))
def test_a_page_is_final_once_no_unseen_row_can_reach_it(first, second, page):
    """Reciprocal ranks, deepened step by step: the page of the first depth at which the bound on unseen rows lies below
    its last row is that of the full depth."""
    def fused(depth):
        out = {}
        for arm in (first, second):
            for r, i in enumerate(arm[:depth], 1):
                out[i] = out.get(i, 0) + 1 / (60 + r)
        return sorted(((-s, i) for i, s in out.items()))

    full = fused(1000)[:page]
    for depth in range(1, 42):
        seen = fused(depth)
        # What a row can still gain in an arm that has not shown it: the rank behind the depth, unless the arm is at its end.
        gain = sum(1 / (60 + depth + 1) for arm in (first, second) if len(arm) > depth)
        last = -seen[page - 1][0] if len(seen) >= page else 0
        if gain == 0 or (len(seen) >= page and all(-s + gain < last for s, i in seen[page:]) and gain < last and _settled(seen, first, second, depth, page)):
            assert seen[:page] == full
            break


def _settled(seen, first, second, depth, page):
    """Whether the page's own rows are seen by both arms as far as they can be."""
    return all(all(i in arm[:depth] or len(arm) <= depth for arm in (first, second)) for _, i in seen[:page])
