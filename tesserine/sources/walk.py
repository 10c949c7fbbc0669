"""A directory tree as a table: `spark.read.format("tree").option("path", root).load()`.

Rows: (path, size, modified, sha256, content, link, error). Paths are relative to the root with forward slashes. Ignore
files are honoured as version control does: within a file the last matching line counts, a deeper file beats the ones
above it, and in one folder `.indexignore` beats `.gitignore`; a list of user patterns stands below both. `.git` is never
entered, at any depth and in any case; a folder that is a repository of its own is only entered if the root's
`.indexignore` takes it in again. Hidden files are listed, links are listed with where they point to but not followed,
names that are not UTF-8 are left out. Each folder below the root is a partition of its own, so that a large tree is read
by many tasks, and so are FILES_A_TASK files of the root each; only the root's own listing is read while planning. With
the option `scope` only the named paths are listed and read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

IGNORE_FILES = (".gitignore", ".indexignore")
OWN_IGNORE = IGNORE_FILES[1]
#: Files of one folder, or named one by one, that a task reads.
FILES_A_TASK = 1000
SCHEMA = "path string, size long, modified long, sha256 string, content binary, link string, error string"


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file: where it stands, what it matches, whether it takes back, whether only folders count."""

    base: str
    pattern: re.Pattern
    keep: bool
    folders: bool

    def matches(self, path: str, folder: bool) -> bool:
        inside = path[len(self.base) + 1 :] if self.base else path
        return (folder or not self.folders) and (not self.base or path.startswith(self.base + "/")) and bool(self.pattern.match(inside))


def parse_rules(text: str, base: str) -> list[Rule]:
    """The rules of an ignore file that stands in the folder `base`."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[keep:].lstrip("\\") if line[keep : keep + 2] in ("\\#", "\\!") else line[keep:]
        folders = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = _glob(line.lstrip("/"))
        if body is not None:
            out.append(Rule(base, re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z", re.S), keep, folders))
    return out


def _glob(glob: str) -> str | None:
    """A glob as a regular expression: `*` and `?` stay within a name, `**` spans folders."""
    out, i = "", 0
    while i < len(glob):
        rest = glob[i:]
        if rest.startswith("**/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rest == "**":
            out, i = out + ".*", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + 1
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[0] == "[" and (m := re.match(r"\[([!^]?)((?:\]|[^\]])[^\]]*)\]", rest)):
            inner = m[2].replace("\\", "\\\\")
            out, i = out + f"[{'^' if m[1] else ''}{inner}]", i + m.end()
        elif rest[0] == "\\" and len(rest) > 1:
            out, i = out + re.escape(rest[1]), i + 2
        else:
            out, i = out + re.escape(rest[0]), i + 1
    try:
        re.compile(out)
    except re.error:
        return None
    return out


def verdict(rules: list[Rule], path: str, folder: bool) -> bool | None:
    """True if the last matching rule ignores the path, False if it takes it back, None if none matches."""
    for rule in reversed(rules):
        if rule.matches(path, folder):
            return not rule.keep
    return None


@dataclass
class Walker:
    root: str
    user_rules: list[Rule]
    skip: str | None = None  # a folder of ours inside the tree

    def own_rules(self, folder: str) -> list[Rule]:
        """The rules of a folder's ignore files, the weaker file first."""
        out: list[Rule] = []
        for name in IGNORE_FILES:
            try:
                with open(os.path.join(self.root, folder, name), encoding="utf-8", errors="replace") as f:
                    out += parse_rules(f.read(), folder)
            except OSError:
                pass
        return out

    def enters(self, path: str, rules: list[Rule]) -> bool:
        full = os.path.join(self.root, path)
        if path.rsplit("/", 1)[-1].lower() == ".git" or verdict(rules, path, True):
            return False
        if self.skip and os.path.realpath(full) == os.path.realpath(self.skip):
            return False
        if os.path.lexists(os.path.join(full, ".git")):
            try:
                with open(os.path.join(self.root, OWN_IGNORE), encoding="utf-8", errors="replace") as f:
                    return verdict(parse_rules(f.read(), ""), path, True) is False
            except OSError:
                return False
        return True

    def listing(self, folder: str, rules: list[Rule]) -> tuple[list[str], list[tuple[str, str | None]]]:
        """(folders to enter, (file, where it links to)) of one folder, in name order."""
        folders, files = [], []
        try:
            entries = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: os.fsencode(e.name))
        except OSError:
            return [], []
        for e in entries:
            try:
                e.name.encode("utf-8")
            except UnicodeEncodeError:
                continue
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink():
                if not verdict(rules, path, False) and e.name.lower() != ".git":
                    files.append((path, os.readlink(e.path)))
            elif e.is_dir(follow_symlinks=False):
                if self.enters(path, rules):
                    folders.append(path)
            elif e.is_file(follow_symlinks=False) and not verdict(rules, path, False) and e.name.lower() != ".git":
                files.append((path, None))
        return folders, files

    def rules_for(self, folder: str) -> list[Rule]:
        """All rules in force inside a folder, weakest first."""
        rules, at = list(self.user_rules), ""
        for part in ["", *folder.split("/")] if folder else [""]:
            at = f"{at}/{part}".strip("/")
            rules += self.own_rules(at)
        return rules

    def named(self, scope: list[str]) -> list[_Part]:
        """Partitions for some paths and what lies below them, as far as a whole walk would come to them; nothing else is
        listed. Paths that another one covers, or that are gone, have none."""
        names = sorted({s.strip("/") for s in scope})
        names = [n for n in names if n and not any(n.startswith(a + "/") for a in names)] if "" not in names else [""]
        if names == [""]:
            return [_Part("", False), *(_Part(f, True) for f in self.listing("", self.rules_for(""))[0])]
        parts, files = [], []
        for n in names:
            above = n.split("/")[:-1]
            if any(p in ("..", ".", "") for p in n.split("/")) or not all(self.enters("/".join(above[: i + 1]), self.rules_for("/".join(above[:i]))) for i in range(len(above))):
                continue
            full, rules = os.path.join(self.root, n), self.rules_for("/".join(above))
            if os.path.isdir(full) and not os.path.islink(full):
                parts += [_Part(n, True)] if self.enters(n, rules) else []
            elif os.path.lexists(full) and not verdict(rules, n, False) and n.rsplit("/", 1)[-1].lower() != ".git":
                files.append(n)
        return parts + [_Part("", False, files[i : i + FILES_A_TASK]) for i in range(0, len(files), FILES_A_TASK)] or [_Part("", False, [])]

    def walk(self, folder: str) -> Iterator[tuple[str, str | None]]:
        stack = [(folder, self.rules_for(folder))]
        while stack:
            here, rules = stack.pop()
            folders, files = self.listing(here, rules)
            yield from files
            stack += [(f, rules + self.own_rules(f)) for f in reversed(folders)]


class _Part(InputPartition):
    """A folder, with what lies below it or without, or some files by name."""

    def __init__(self, folder: str, deep: bool, files: list[str] | None = None):
        super().__init__((folder, deep))
        self.folder, self.deep, self.files = folder, deep, files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.content = options.get("content", "true").lower() == "true"
        self.walker = Walker(self.root, parse_rules(options.get("ignore", ""), ""), options.get("skip"))
        self.scope = options["scope"].split("\n") if "scope" in options else None

    def partitions(self):
        if self.scope is not None:
            return self.walker.named(self.scope)
        folders, files = self.walker.listing("", self.walker.rules_for(""))
        flat = [f for f, _ in files]
        return [*(_Part("", False, flat[i : i + FILES_A_TASK]) for i in range(0, len(flat), FILES_A_TASK)), *(_Part(f, True) for f in folders)] or [_Part("", False)]

    def read(self, partition):
        w = self.walker
        if partition.files is not None:
            entries = [(f, os.readlink(full) if os.path.islink(full := os.path.join(self.root, f)) else None) for f in partition.files]
        else:
            entries = w.walk(partition.folder) if partition.deep else w.listing("", w.rules_for(""))[1]
        for path, link in entries:
            if link is not None:
                yield (path, None, None, None, None, link, None)
                continue
            try:
                full = os.path.join(self.root, path)
                with open(full, "rb") as f:
                    data = f.read()
                yield (path, len(data), int(os.stat(full).st_mtime), hashlib.sha256(data).hexdigest(), data if self.content else None, None, None)
            except FileNotFoundError:
                continue  # gone since it was listed: absent
            except OSError as e:
                yield (path, None, None, None, None, None, e.strerror or "unreadable")


class TreeDataSource(DataSource):
    """Options: path (required), scope (paths, one per line), ignore (user patterns, one per line), content (false: hashes only), skip (a folder)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("the tree source needs a path")
        return _Reader(dict(self.options))


def read_tree(spark, path: str, **options: str):
    """The tree at `path` as a DataFrame."""
    spark.dataSource.register(TreeDataSource)
    return spark.read.format("tree").options(path=path, **options).load()


def observe(spark, path: str, scope: list[str] | None = None, **options: str):
    """(observed, unreadable): what a project's tree holds, restricted to some paths and what lies below them if given."""
    if scope is not None:
        options = {**options, "scope": "\n".join(scope) or ".."}  # nothing named is nothing seen
    rows = read_tree(spark, path, **options).where("link is null")
    return rows.where("error is null").drop("error", "link"), rows.where("error is not null").select("path", "error")
