"""The registry of projects as a TOML file beside the store: what a user edits by hand, and what a lost store is rebuilt from.

    [[project]]
    key = "notes"
    name = "Notes"
    root = "/srv/notes"
    kind = "repo"

The file wins over the store: projects that it names are registered or renamed, others are removed. A file that cannot be
read is never overwritten; it is moved aside, and a new one is written from the store, as where there is none.
"""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import functions as F

from tesserine.sources.store import ChunkStore

FILE = "projects.toml"
FIELDS = ("key", "name", "root", "kind")
KINDS = ("repo", "session")


@dataclass(frozen=True)
class Reconciled:
    """What a reconciliation did: whether the file was written from the store, and how many projects changed."""

    bootstrapped: bool
    inserted: int = 0
    updated: int = 0
    removed: int = 0
    quarantined: bool = False


def parse_registry(text: str) -> list[dict[str, str]]:
    """The projects of a registry, in order. ValueError if it is no TOML, has unknown keys or kinds, or a project without a
    name or a root."""
    raw = tomllib.loads(text)
    if set(raw) - {"project"} or not isinstance(raw.get("project", []), list):
        raise ValueError("a registry holds projects alone")
    out = []
    for p in raw.get("project", []):
        if not isinstance(p, dict) or set(p) - set(FIELDS) or not all(isinstance(v, str) and v for v in p.values()):
            raise ValueError(f"not a project: {p}")
        if "name" not in p or "root" not in p or p.get("kind", "repo") not in KINDS:
            raise ValueError(f"a project needs a name, a root and a known kind: {p}")
        out.append({"kind": "repo", **p})
    return out


def render_registry(projects: list[dict[str, str]]) -> str:
    """The file of a list of projects."""
    blocks = ["[[project]]\n" + "".join(f"{f} = {json.dumps(p[f], ensure_ascii=False)}\n" for f in FIELDS if p.get(f)) for p in projects]
    return "\n".join(blocks)


class Registry:
    def __init__(self, store: ChunkStore):
        self.store, self.path = store, f"{store.folder}/{FILE}"

    def _read(self) -> str | None:
        fs, path = self.store._fs, self.store._path(self.path)
        if not fs.exists(path):
            return None
        rows = self.store.spark.read.format("binaryFile").load(self.path).select("content").first()
        return bytes(rows[0]).decode()

    def write(self) -> None:
        """Write the store's projects, under another name first, so that no reader sees half of it."""
        rows = self.store.projects().select(F.col("project_key").alias("key"), "name", "root", "kind").collect()  # a registry
        part = self.store._path(self.path + ".part")
        out = self.store._fs.create(part, True)
        out.write(bytearray(render_registry([r.asDict() for r in rows]).encode()))
        out.close()
        self.store._fs.delete(self.store._path(self.path), False)
        self.store._fs.rename(part, self.store._path(self.path))
        # A local file system keeps a checksum beside the file, which an edit by hand would break.
        if self.store._path(self.path).toUri().getScheme() in (None, "file"):
            Path(self.store._path(self.path).toUri().getPath()).with_name(f".{FILE}.crc").unlink(missing_ok=True)

    def reconcile(self) -> Reconciled:
        """Bring the store in line with the file, or write the file where there is none that can be read."""
        quarantined = False
        try:
            text = self._read()
            wanted = None if text is None else parse_registry(text)
        except (ValueError, UnicodeDecodeError):  # tomllib's error is a ValueError
            aside = self.store._path(self.path + ".damaged")
            self.store._fs.delete(aside, False)
            self.store._fs.rename(self.store._path(self.path), aside)
            wanted, quarantined = None, True
        if wanted is None:
            self.write()
            return Reconciled(True, quarantined=quarantined)
        facts = lambda: {r["root"]: (r["name"], r["kind"]) for r in self.store.projects().collect()}
        before = facts()
        self.store.apply_projects(wanted)
        after = facts()
        self.write()
        return Reconciled(
            False, inserted=len(after.keys() - before.keys()), removed=len(before.keys() - after.keys()),
            updated=sum(before[r] != after[r] for r in before.keys() & after.keys()))
