"""Text as column expressions: tokens, references, excerpts, names, paths. All stay on the JVM side."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_TERMS = 64
EXCERPT_CHARS = 2000
DEFAULT_LIMIT, MAX_LIMIT = 10, 100
SHORT_ID = 12


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """Lower-case Latin, Greek and Cyrillic letters with diacritics, and the letters without them, by Unicode decomposition."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        letter = chr(code).lower()
        base = unicodedata.normalize("NFD", letter)[0]
        if len(letter) == 1 and base != letter and base.isalpha():
            pairs.append((letter, base))
    unique = dict(pairs)
    return "".join(unique), "".join(unique.values())


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    marked, plain = accents()
    return F.translate(F.lower(text), marked, plain)


def tokens(text: Column) -> Column:
    """The tokens of a text: runs of letters, digits and `_`, folded. Null has none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


@dataclass(frozen=True)
class Term:
    """One term of a query; a prefix term matches every token that begins with it."""

    text: str
    prefix: bool = False


def query_terms(query: str) -> list[Term]:
    """The terms of free text. Runs of letters, digits and `_`; a `*` right behind a run makes it a prefix; bare
    upper-case AND, OR, NOT and NEAR are operators of other systems and dropped; the first MAX_TERMS count. Repeats
    stay: each counts when scoring. Whatever is typed, nothing here is a syntax error."""
    marked, plain = accents()
    table = str.maketrans(marked, plain)
    out: list[Term] = []
    for m in re.finditer(r"(\w+)(\*?)", query):
        word, star = m.groups()
        if not star and word in ("AND", "OR", "NOT", "NEAR"):
            continue
        out.append(Term(word.lower().translate(table), bool(star)))
        if len(out) == MAX_TERMS:
            break
    return out


def decision_refs(text: Column) -> Column:
    """The distinct D-NNNN references of a text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])(D-[0-9]{4})(?![A-Za-z0-9_])"), 1))


def merge_refs(first: Column, second: Column) -> Column:
    """Both lists without repeats, the first one's order leading; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(first, none), F.coalesce(second, none)))


def excerpt(text: Column, chars: int = EXCERPT_CHARS) -> Column:
    """The first characters of a text."""
    return F.substring(text, 1, chars)


def truncated(text: Column, chars: int = EXCERPT_CHARS) -> Column:
    return F.char_length(text) > chars


def clamp_limit(limit: int | None) -> int:
    return min(DEFAULT_LIMIT if limit is None else max(0, limit), MAX_LIMIT)


def clamped(limit: Column) -> Column:
    """clamp_limit as an expression."""
    return F.when(limit.isNull(), DEFAULT_LIMIT).otherwise(F.least(F.greatest(limit, F.lit(0)), F.lit(MAX_LIMIT)))


def slug(name: Column, chars: int = 40) -> Column:
    """An ASCII key for a name: lower-case letters and digits joined by `-`, at most `chars` long; `project` if none remain."""
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, chars), "-+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", "project").otherwise(cut)


def strip_discriminators(name: Column) -> Column:
    """A symbol path without the `#w1`, `#d1`, `#s1` marks that only keep anchors apart."""
    return F.regexp_replace(name, r"(\.*#[wds][0-9]+)+$", "")


def display_symbol(name: Column) -> Column:
    """As shown to readers: filler and window marks go, marks of genuine repeats stay."""
    return F.regexp_replace(name, r"(\.*#[ws][0-9]+)+$", "")


def display_headings(path: Column) -> Column:
    """A heading path as text, without elements that are only filler or window marks."""
    return F.array_join(F.filter(path, lambda h: ~h.rlike(r"^#[ws][0-9]+$")), " > ")


def anchor_phrase(kind: Column, symbol_path: Column, heading_path: Column) -> Column:
    """What a chunk is about, in words, for its embedding header."""
    headings = F.array_join(F.filter(heading_path, lambda h: ~h.rlike(r"^#[wds][0-9]+$")), " > ")
    return F.when(kind == "code", strip_discriminators(symbol_path)).when(kind == "section", headings).otherwise("")


def embed_text(language: Column, path: Column, phrase: Column, text: Column, prefix: str = "") -> Column:
    """A chunk as it is embedded: prefix, a header of language, path and phrase, and the text on the next line."""
    parts = [F.when(c != "", c) for c in (language, path, phrase)]
    return F.concat(F.lit(prefix), F.concat_ws(" ", *parts), F.lit("\n"), text)


def embed_query(query: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), query)


@F.pandas_udf(StringType())
def truncate_utf8(text: pd.Series, limit: pd.Series) -> pd.Series:
    """The longest beginning of a text that fits into so many UTF-8 bytes; never cuts a character. Spark's own functions
    raise on a character cut in half, hence the Arrow function."""
    return pd.Series([None if t is None else t.encode()[: int(n)].decode(errors="ignore") for t, n in zip(text, limit)])


def short_id(chunk_id: Column) -> Column:
    return F.left(chunk_id, F.lit(SHORT_ID))


def is_id_prefix(text: Column, least: int = 8) -> Column:
    """Whether a text can begin a chunk id: hex digits, at least `least` of them."""
    return F.lower(text).rlike(rf"^[0-9a-f]{{{least},}}$")


def is_within(path: Column, root: Column) -> Column:
    """Whether a path is the root or lies under it; `ab` does not lie under `a`."""
    return (path == root) | F.startswith(path, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def relative_to(path: Column, root: Column) -> Column:
    """A path from the root on: empty for the root itself, null for what lies elsewhere."""
    bare = F.rtrim(root, F.lit("/"))
    return F.when(path == bare, "").when(F.startswith(path, F.concat(bare, F.lit("/"))), F.substr(path, F.char_length(bare) + 2))


def is_git_metadata(path: Column) -> Column:
    """Whether any part of a path is `.git`, in any case."""
    return F.exists(F.split(path, "/"), lambda p: F.lower(p) == ".git")


#: Why a manifest path is malformed, first match first.
MALFORMED = [
    ("empty", lambda p: p == ""),
    ("backslash", lambda p: F.contains(p, F.lit("\\"))),
    ("absolute", lambda p: F.startswith(p, F.lit("/"))),
    ("drive letter", lambda p: p.rlike("^[A-Za-z]:")),
]


def malformed_path(path: Column) -> Column:
    """Why a path cannot stand in a manifest, or null: empty, backslash, absolute, drive letter, and by the first
    offending part: empty component, parent component, git metadata."""
    reason = F.when(path.isNull(), "empty")
    for name, test in MALFORMED:
        reason = reason.when(test(path), name)

    def fault(part: Column) -> Column:
        return F.when(part == "", "empty component").when(part == "..", "parent component").when(F.lower(part) == ".git", "git metadata")

    parts = F.filter(F.transform(F.split(path, "/"), fault), lambda f: f.isNotNull())
    return reason.otherwise(F.try_element_at(parts, F.lit(1)))


def chunk_id(path: Column, anchor: Column, text: Column) -> Column:
    """Content-addressed identity: equal path, anchor and text give an equal id. SHA-256 of the three with NUL between."""
    nul = F.lit("\x00")
    return F.sha2(F.concat(path, nul, anchor, nul, text), 256)


def expand_lines(text: Column, start: Column, end: Column, context: int = 20) -> Column:
    """Lines start-context to end+context of a text, 1-based and clamped to it; context at most 200."""
    context = min(max(context, 0), 200)
    lines = F.split(text, "\n")
    first = F.greatest(start - context, F.lit(1))
    last = F.least(end + context, F.size(lines))
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
