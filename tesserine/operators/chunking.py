"""Files to chunks: a table function over (project_id, path, content).

Spans count UTF-8 bytes, half open; lines count from 1, inclusive; the text of a chunk is the exact slice of its file.
Everything about one file is decided from that file alone, so the operator is a single pass without a shuffle. The cutting
itself is a recurrence over the lines of a file that no expression can state, hence Arrow batches of Python.

Python sources are cut along their syntax tree. For C#, Rust, JavaScript and TypeScript no grammar is at hand; they are cut
by a scanner that follows braces, strings and comments, an approximation that falls back to windows where braces do not
match.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILE_BYTES = 2 * 1024 * 1024
SNIFF_BYTES = 8 * 1024
MACHINE_LINE_BYTES = 4096
MAX_CHUNK_BYTES = 4000
TINY_BYTES = 200
SMALL_CONTAINER_BYTES = 1200
MIN_INTRO_BYTES = 24
WINDOW_LINES, WINDOW_BYTES, WINDOW_OVERLAP = 80, 8000, 10
BOM = b"\xef\xbb\xbf"

#: The language of a file by its extension.
LANGUAGES = {"cs": "csharp", "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "md": "markdown"}

CHUNK_FIELDS = (
    "chunk_id string, path string, anchor string, kind string, language string, byte_start int, byte_end int, line_start int, line_end int, "
    "text string, vault string, design_status string, authority_tier int"
)


@dataclass(frozen=True)
class Windows:
    """The geometry of line windows. A plugin may tighten it, never loosen it."""

    lines: int = WINDOW_LINES
    max_bytes: int = WINDOW_BYTES
    overlap: int = WINDOW_OVERLAP

    def tightened(self, lines: int | None, overlap: int | None) -> Windows:
        lines = min(self.lines, lines or self.lines)
        return Windows(lines, self.max_bytes, min(self.overlap if overlap is None else overlap, self.overlap, lines - 1))


@dataclass
class Chunk:
    kind: dict
    start: int
    end: int
    language: str | None
    text: str
    vault: dict | None = None

    @property
    def anchor(self) -> str:
        k = self.kind
        if k["kind"] == "code":
            return "code:" + k["symbol_path"]
        return "md:" + " > ".join(k["heading_path"]) if k["kind"] == "section" else f"win:{k['index']}"


def content_id(path: str, anchor: str, text: str) -> str:
    """As functions.text.chunk_id."""
    return hashlib.sha256("\0".join((path, anchor, text)).encode("utf-8", "surrogatepass")).hexdigest()


class Lines:
    """Line starts of a file's bytes."""

    def __init__(self, src: bytes):
        self.src = src
        self.starts = [0, *(m.end() for m in re.finditer(b"\n", src))]
        self.count = len(self.starts) - (len(self.starts) > 1 and self.starts[-1] == len(src))

    def of(self, byte: int) -> int:
        import bisect

        return max(1, bisect.bisect_right(self.starts, byte))

    def begin(self, line: int) -> int:
        return self.starts[min(line - 1, len(self.starts) - 1)]

    def finish(self, line: int) -> int:
        return self.starts[line] if line < len(self.starts) else len(self.src)

    def windows(self, first: int, last: int, lines: int | None, max_bytes: int, overlap: int) -> Iterator[tuple[int, int]]:
        """Line ranges that cover first..last: each as long as both limits allow but at least one line, each sharing
        `overlap` lines with the one before, each beginning further down."""
        a = first
        while True:
            b = a
            while b < last and (lines is None or b + 2 - a <= lines) and self.finish(b + 1) - self.begin(a) <= max_bytes:
                b += 1
            yield a, b
            if b >= last:
                return
            a = max(a + 1, b + 1 - overlap)


@dataclass
class Collector:
    """Chunks of one file in the making."""

    path: str
    src: bytes
    language: str | None = None
    vault: dict | None = None
    lines: Lines = field(init=False)
    chunks: list[Chunk] = field(default_factory=list)
    families: int = 0

    def __post_init__(self) -> None:
        self.lines = Lines(self.src)

    def trim(self, start: int, end: int) -> tuple[int, int] | None:
        """The span without surrounding white space and without a byte order mark at the file's beginning; None if
        nothing remains."""
        if start == 0 and self.src.startswith(BOM):
            start = len(BOM)
        text = self.src[start:end].decode(errors="replace")
        body = text.strip()
        if not body:
            return None
        start += len(text[: len(text) - len(text.lstrip())].encode())
        return start, start + len(body.encode())

    def exact(self, start: int, end: int, kind: dict) -> None:
        if span := self.trim(start, end):
            text = self.src[span[0] : span[1]].decode(errors="replace")
            vault = None
            if self.vault is not None:
                vault = {**self.vault, "body_decision_refs": references(text)}
            self.chunks.append(Chunk(kind, *span, self.language, text, vault))

    def span(self, start: int, end: int, kind: dict) -> None:
        """One chunk, or overlapping windows if it is too large; these form a family of their own."""
        if not (span := self.trim(start, end)):
            return
        start, end = span
        if end - start <= MAX_CHUNK_BYTES:
            return self.exact(start, end, kind)
        family, self.families = self.families, self.families + 1
        ranges = self.lines.windows(self.lines.of(start), self.lines.of(end - 1), None, MAX_CHUNK_BYTES, WINDOW_OVERLAP)
        for i, (a, b) in enumerate(ranges):
            part = {**marked(kind, f"#w{i}"), "window": {"family": family, "index": i}}
            self.exact(max(self.lines.begin(a), start), min(self.lines.finish(b), end), part)

    def rows(self) -> list[tuple]:
        """The chunks as CHUNK_FIELDS; equal ids within a file are kept apart by a mark on the later ones."""
        seen: set[str] = set()
        out = []
        for c in self.chunks:
            n, key = 1, content_id(self.path, c.anchor, c.text)
            while key in seen and c.kind["kind"] != "window":
                c.kind = marked(c.kind, f"#d{n}")
                n, key = n + 1, content_id(self.path, c.anchor, c.text)
            if key in seen:
                continue
            seen.add(key)
            status = (c.vault or {}).get("design_status")
            tier = {"decided": 3, "leaning": 2, "deprecated": 0}.get(status, 1)
            out.append((key, self.path, c.anchor, json.dumps(c.kind), c.language, c.start, c.end, self.lines.of(c.start), self.lines.of(c.end - 1), c.text, json.dumps(c.vault) if c.vault is not None else None, status, tier))
        return out


def marked(kind: dict, mark: str) -> dict:
    """The kind with a mark on its symbol path or as a further heading."""
    if kind["kind"] == "code":
        return {**kind, "symbol_path": kind["symbol_path"] + mark}
    if kind["kind"] == "section":
        return {**kind, "heading_path": [*kind["heading_path"], mark]}
    return kind


def references(text: str) -> list[str]:
    """The distinct D-NNNN references, in order."""
    return list(dict.fromkeys(re.findall(r"(?<![A-Za-z0-9_])D-[0-9]{4}(?![A-Za-z0-9_])", text)))


# --- skipping and routing -------------------------------------------------------------------------------------------


def skip_reason(content: Column) -> Column:
    """Why a file (binary content) is not indexed at all, or null: too large, binary, or not UTF-8."""
    return (
        F.when(F.octet_length(content) > MAX_FILE_BYTES, "too large")
        .when(F.contains(F.substring(content, 1, SNIFF_BYTES), F.lit(b"\x00")), "binary")
        .when(~F.is_valid_utf8(content.cast("string")), "invalid utf-8")
    )


def machine_text(text: Column) -> Column:
    """Whether a text has a line of more than MACHINE_LINE_BYTES bytes; such files are not cut into plain windows."""
    return F.exists(F.split(text, "\n"), lambda line: F.octet_length(line) > MACHINE_LINE_BYTES)


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def language_column(path: Column) -> Column:
    """language_of as an expression."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    out = F.lit(None).cast("string")
    for e, language in LANGUAGES.items():
        out = F.when(ext == e, language).otherwise(out)
    return out


@dataclass(frozen=True)
class Plugin:
    """A declared chunker: a name, the extensions it claims and how its windows are tightened."""

    name: str
    extensions: tuple[str, ...]
    lines: int | None = None
    overlap: int | None = None


def claims(plugins: Iterable[Plugin]) -> dict[str, Plugin]:
    """Which plugin cuts which extension. Built-in languages cannot be claimed, and an extension that two plugins claim
    goes to neither."""
    out: dict[str, Plugin | None] = {}
    for p in plugins:
        for e in p.extensions:
            out[e] = None if e in out else p
    return {e: p for e, p in out.items() if p is not None and e not in LANGUAGES}


def chunk_file(path: str, content: bytes, vault_profile: bool = False, plugins: Iterable[Plugin] = ()) -> tuple[list[tuple], str | None]:
    """(rows as CHUNK_FIELDS, why the file was skipped). vault_profile: whether front matter has a meaning here."""
    if len(content) > MAX_FILE_BYTES:
        return [], "too large"
    if b"\0" in content[:SNIFF_BYTES]:
        return [], "binary"
    try:
        content.decode()
    except UnicodeDecodeError:
        return [], "invalid utf-8"
    language = language_of(path)
    if language == "markdown":
        return markdown(path, content, vault_profile).rows(), None
    if language:
        made = code(path, content, language)
        if made is not None:
            return made.rows(), None
    if any(len(line) > MACHINE_LINE_BYTES for line in content.split(b"\n")):
        return [], "machine text"
    claimed = claims(plugins).get(path.rsplit(".", 1)[-1].lower())
    geometry = Windows().tightened(claimed.lines, claimed.overlap) if claimed else Windows()
    return plain_windows(path, content, language, geometry).rows(), None


def plain_windows(path: str, src: bytes, language: str | None = None, geometry: Windows = Windows()) -> Collector:
    """Line windows over a text of no known structure; blank windows are left out but keep their number."""
    c = Collector(path, src, language)
    if src:
        for i, (a, b) in enumerate(c.lines.windows(1, c.lines.count, geometry.lines, geometry.max_bytes, geometry.overlap)):
            c.exact(c.lines.begin(a), c.lines.finish(b), {"kind": "window", "index": i})
    return c


# --- markdown ---------------------------------------------------------------------------------------------------------


def front_matter(src: bytes) -> tuple[dict, int]:
    """(design_status and decision_refs of the leading `---` block, where the body begins). A block without an end is
    no block."""
    start = len(BOM) if src.startswith(BOM) else 0
    block = re.compile(rb"---[ \t\r]*\n(.*?)^(?:---|\.\.\.)[ \t\r]*(?:\n|\Z)", re.S | re.M).match(src, start)
    if not block:
        return {"design_status": None, "decision_refs": []}, start
    status, refs, key = None, [], ""
    for line in block[1].decode(errors="replace").splitlines():
        entry = re.match(r"([^\s:#\-][^:]*):(.*)", line)
        item = re.match(r"\s*- (.*)", line)
        if item and key == "decision_refs":
            refs += _listed(item[1])
        elif entry:
            key, value = entry[1].strip(), entry[2].strip()
            if key == "design_status":
                status = value.strip("\"'").lower() if value.strip("\"'").lower() in ("exploration", "leaning", "decided", "deprecated") else None
            elif key == "decision_refs":
                refs += _listed(value)
    return {"design_status": status, "decision_refs": list(dict.fromkeys(refs))}, block.end()


def _listed(value: str) -> list[str]:
    out: list[str] = []
    for part in re.sub(r"^\[(?!\[)(.*)\]$", r"\1", value.strip()).split(","):
        word = re.sub(r"^\[\[|\]\]$", "", part.strip().strip("\"'")).strip()
        out += references(word) or ([word] if word else [])
    return out


def heading_title(rest: str) -> str:
    """A heading without its closing `#`s, which count only behind a blank or as the whole content."""
    return re.sub(r"(?:^|[ \t]+)#+$", "", rest.strip()).strip()


def headings(src: bytes, start: int) -> Iterator[tuple[int, str, int, int]]:
    """(level, title, where its line begins, where it ends) of the `#` headings outside fences."""
    fence: tuple[str, int] | None = None
    at = start
    for raw in src[start:].splitlines(keepends=True) if b"\n" not in src[start:] else re.findall(rb"[^\n]*\n|[^\n]+", src[start:]):
        line = raw.decode(errors="replace").lstrip()
        run = re.match(r"(`+|~+|#+)", line)
        if run:
            mark, n = run[1][0], len(run[1])
            if fence:
                if mark == fence[0] and n >= fence[1] and not line[n:].strip():
                    fence = None
            elif mark in "`~" and n >= 3:
                fence = (mark, n)
            elif mark == "#" and n <= 6 and (not line[n:].strip() or line[n] in " \t"):
                yield n, heading_title(line[n:]), at, at + len(raw)
        at += len(raw)


def document_headings(documents: DataFrame) -> DataFrame:
    """(doc_id, place, level, title) of the headings of documents (doc_id, text)."""

    def scan(batches):
        for b in batches:
            rows = [(i, n, h[0], h[1]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for n, h in enumerate(headings(t.encode(), 0), 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "place", "level", "title"])

    return documents.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, place int, level int, title string")


def markdown(path: str, src: bytes, vault_profile: bool) -> Collector:
    """One section per heading, up to the next heading. The text between a heading and its first subheading is a
    section of its own if it is long enough, else it joins the next section."""
    vault, body = front_matter(src)
    c = Collector(path, src, "markdown", vault if vault_profile else None)
    found = list(headings(src, body))
    c.span(body, found[0][2] if found else len(src), {"kind": "section", "heading_path": []})
    above: list[tuple[int, str]] = []
    waiting: int | None = None
    for i, (level, title, begin, after) in enumerate(found):
        above = [h for h in above if h[0] < level]
        following = found[i + 1] if i + 1 < len(found) else None
        end = following[2] if following else len(src)
        intro = c.trim(after, end)
        path_here = [*(t for _, t in above), title]
        if following and following[0] > level and (intro[1] - intro[0] if intro else 0) < MIN_INTRO_BYTES:
            waiting = after if waiting is None else waiting
        else:
            c.span(begin if waiting is None else waiting, end, {"kind": "section", "heading_path": path_here})
            waiting = None
        above.append((level, title))
    return c


# --- code -------------------------------------------------------------------------------------------------------------


@dataclass
class Item:
    """A declaration: bytes, what it is called, and what it contains."""

    start: int
    end: int
    kind: str
    name: str
    members: list[Item] = field(default_factory=list)


def code(path: str, src: bytes, language: str) -> Collector | None:
    """Declarations and the statements between them, or None where the source cannot be parsed."""
    items = python_items(src) if language == "python" else brace_items(src, language)
    if items is None:
        return None
    c = Collector(path, src, language)
    _emit(c, items, 0, len(src), "")
    return c


def _emit(c: Collector, items: list[Item], start: int, end: int, scope: str) -> None:
    """All of start..end: declarations, with the runs between them as `statements`; tiny neighbours are merged into
    groups and large containers split into header and members."""
    parts: list[Item] = []
    at, fillers = start, 0
    for item in [*items, None]:
        stop = item.start if item else end
        if c.trim(at, stop):
            parts.append(Item(at, stop, "statements", f"#s{fillers}"))
            fillers += 1
        if item:
            parts.append(item)
            at = item.end
    qualified = lambda name: f"{scope}.{name}" if scope else name
    i = 0
    while i < len(parts):
        j = i
        while j < len(parts) and parts[j].end - parts[j].start < TINY_BYTES and parts[j].end - parts[i].start <= MAX_CHUNK_BYTES:
            j += 1
        if j - i > 1:
            c.span(parts[i].start, parts[j - 1].end, {"kind": "code", "symbol_kind": "group", "symbol_path": qualified(parts[i].name)})
            i = j
            continue
        p = parts[i]
        if p.members and p.end - p.start > SMALL_CONTAINER_BYTES:
            first = p.members[0].start
            c.span(p.start, first, {"kind": "code", "symbol_kind": p.kind, "symbol_path": qualified(p.name)})
            _emit(c, p.members, first, p.end, qualified(p.name))
        else:
            c.span(p.start, p.end, {"kind": "code", "symbol_kind": p.kind, "symbol_path": qualified(p.name)})
        i += 1


def python_items(src: bytes) -> list[Item] | None:
    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = Lines(src)

    def collect(body: list[ast.stmt], floor: int) -> list[Item]:
        out = []
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                line = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                while line > 1 and lines.begin(line - 1) >= floor and src[lines.begin(line - 1) : lines.finish(line - 1)].lstrip().startswith(b"#"):
                    line -= 1  # comments right above belong to it
                end = lines.finish(node.end_lineno)
                inner = collect(node.body, lines.begin(node.lineno)) if isinstance(node, ast.ClassDef) else []
                out.append(Item(lines.begin(line), end, "class" if isinstance(node, ast.ClassDef) else "function", node.name, inner))
                floor = end
        return out

    return collect(tree.body, 0)


#: What opens a declaration, by language: (what it is, pattern with the name, whether it has members).
_MODS = rb"(?:(?:public|private|protected|internal|static|sealed|abstract|partial|async|export|default|declare|readonly|override|virtual|unsafe|extern|const|pub(?:\([^)]*\))?)\s+)*"
_DECLARATIONS: dict[str, list[tuple[str, re.Pattern, bool]]] = {
    "csharp": [
        ("namespace", re.compile(rb"namespace\s+([\w.]+)"), True),
        ("class", re.compile(_MODS + rb"(?:class|struct|interface|record|enum)\s+(\w+)"), True),
        ("method", re.compile(_MODS + rb"[\w<>\[\],.?]+\s+(\w+)\s*(?:<[^>(]*>)?\([^;{}]*\)\s*(?:where[^{;]*)?$"), False),
        ("property", re.compile(_MODS + rb"[\w<>\[\],.?]+\s+(\w+)\s*$"), False),
    ],
    "rust": [
        ("impl", re.compile(rb"(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+([^{]+?)\s*(?:where[^{]*)?$"), True),
        ("trait", re.compile(_MODS + rb"trait\s+(\w+)"), True),
        ("mod", re.compile(_MODS + rb"mod\s+(\w+)"), True),
        ("struct", re.compile(_MODS + rb"(?:struct|enum|union)\s+(\w+)"), False),
        ("function", re.compile(_MODS + rb"(?:async\s+|unsafe\s+|const\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(\w+)"), False),
    ],
    "javascript": [
        ("class", re.compile(_MODS + rb"(?:class|interface|namespace|enum)\s+(\w+)"), True),
        ("function", re.compile(_MODS + rb"function\s*\*?\s*(\w+)"), False),
        ("function", re.compile(_MODS + rb"(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>\s*$"), False),
        ("method", re.compile(_MODS + rb"(?:get\s+|set\s+|\*\s*)?(\w+)\s*\([^{};]*\)\s*(?::[^{]+)?$"), False),
    ],
}
_DECLARATIONS["typescript"] = _DECLARATIONS["javascript"]
_COMMENTS = rb"//[^\n]*|/\*.*?\*/"
#: What the scanner steps over or stops at, by language: comments, strings of every kind, braces and ends of statements.
_TOKENS = {
    "csharp": re.compile(
        _COMMENTS + rb"|(\"{3,}).*?\1|(?:\$@|@\$?)\"(?:\"\"|[^\"])*\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{1,4}|.)|[^'\\\n])'|[{};]", re.S),
    "rust": re.compile(
        rb"//[^\n]*|/\*|b?r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.)|[^'\\\n])'|[{};]", re.S),
    "javascript": re.compile(
        _COMMENTS + rb"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|\$\{(?:[^{}`]|`(?:\\.|[^`\\])*`|\{(?:[^{}`]|`(?:\\.|[^`\\])*`)*\})*\}|[^`\\])*`|[{};/]", re.S),
}
_TOKENS["typescript"] = _TOKENS["javascript"]
#: A regular expression literal stands where a value may begin: at the start, behind these characters or words.
_REGEX = re.compile(rb"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_BEFORE_VALUE = re.compile(rb"(?:^|[=(,:;!&|?{}\[+\-*%~^<>]|\b(?:return|typeof|case|in|of|do|else|throw|yield|await))\s*\Z")


def _marks(src: bytes, language: str) -> Iterator[tuple[bytes, int, int]]:
    """The braces and semicolons of a source outside of comments and literals: (mark, begin, end)."""
    at, pattern = 0, _TOKENS[language]
    while m := pattern.search(src, at):
        t, at = m[0], m.end()
        if t == b"/*":  # comments of Rust nest
            depth = 1
            while depth and (n := re.compile(rb"/\*|\*/").search(src, at)):
                depth, at = depth + (1 if n[0] == b"/*" else -1), n.end()
            at = len(src) if depth else at
        elif t == b"/":
            literal = _REGEX.match(src, m.start())
            if literal and _BEFORE_VALUE.search(src[max(0, m.start() - 80) : m.start()]):
                at = literal.end()
        elif t in (b"{", b"}", b";"):
            yield t, m.start(), at


_CONTROL = re.compile(rb"(?:if|for|foreach|while|switch|catch|using|lock|match|loop|else|do|try|return|new)\b")


def brace_items(src: bytes, language: str) -> list[Item] | None:
    """Declarations of a language with braces, by nesting; None if the braces do not match."""
    rules = _DECLARATIONS[language]
    root = Item(0, len(src), "file", "")
    stack: list[tuple[Item | None, int]] = [(root, 0)]  # what is open, and where its current statement began
    for t, begin, end in _marks(src, language):
        owner, since = stack[-1]
        if t == b";":
            stack[-1] = (owner, end)
        elif t == b"{":
            item = None
            if owner is not None and (owner is root or owner.kind in ("namespace", "class", "impl", "trait", "mod")):
                item = _declared(src, since, begin, rules)
            if item:
                owner.members.append(item)
                inside = item if any(k == item.kind and m for k, _, m in rules) else None
                stack.append((inside, end))
                item.end = -1  # until its brace closes
            else:
                stack.append((None, end))
        elif t == b"}":
            if len(stack) == 1:
                return None
            stack.pop()
            owner, _ = stack[-1]
            if owner is not None and owner.members and owner.members[-1].end == -1:
                owner.members[-1].end = end
            stack[-1] = (owner, end)
    return root.members if len(stack) == 1 else None


def _declared(src: bytes, since: int, brace: int, rules) -> Item | None:
    raw = src[since:brace]
    start = since + len(raw) - len(raw.lstrip())
    # Comments and attributes in front belong to the declaration, unless an empty line parts them.
    head = re.sub(rb"//[^\n]*|/\*.*?\*/", lambda m: b" " * len(m[0]), src[start:brace], flags=re.S)
    head = re.sub(rb"^\s*(?:(?:#!?\[[^\n]*\]|\[[^\n]*\]|@\w+(?:\([^)]*\))?)\s*)*", b"", head).strip()
    if not head or _CONTROL.match(head):
        return None
    for kind, pattern, _ in rules:
        if m := pattern.match(head):
            name = re.sub(r"\s+", " ", m[1].decode(errors="replace"))
            if kind == "impl" and " for " in name:
                trait, _, target = name.partition(" for ")
                name = f"{target}#{trait}"
            while (gap := re.match(rb"(?:\s*//[^\n]*\n|\s*/\*.*?\*/)+?[ \t]*\n[ \t]*\n", src[start:brace], re.S)) and gap.end():
                start += gap.end()
            return Item(start, brace, kind, name.replace("::", "."))
    return None


# --- the operator -------------------------------------------------------------------------------------------------------


def chunk_files(files: DataFrame, vault_projects: tuple[int, ...] = (), plugins: tuple[Plugin, ...] = ()) -> DataFrame:
    """(project_id, CHUNK_FIELDS) of files (project_id, path, content binary). Skipped files give no rows, see
    skipped_files. Files with a null path or content give none either."""

    def cut(batches):
        names = ["project_id", *(f.split()[0] for f in CHUNK_FIELDS.split(", "))]
        types = [pa.int64(), *({"string": pa.string(), "int": pa.int32()}[f.split()[1]] for f in CHUNK_FIELDS.split(", "))]
        for batch in batches:
            rows: list[tuple] = []
            for project, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(project, *r) for r in chunk_file(path, content, project in vault_projects, plugins)[0]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)

    known = files.where("path is not null and content is not null").select("project_id", "path", "content")
    return known.mapInArrow(cut, f"project_id long, {CHUNK_FIELDS}")


def skipped_files(files: DataFrame) -> DataFrame:
    """(project_id, path, reason) of the files that are not indexed, on the JVM side."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    windowed = ~ext.isin(list(LANGUAGES))
    reason = F.coalesce(skip_reason(F.col("content")), F.when(windowed & machine_text(F.col("content").cast("string")), "machine text"))
    return files.where("path is not null").select("project_id", "path", reason.alias("reason")).where("reason is not null")
