"""Credentials embedded in source code: found through a trigram index, verified by regexes, redacted in place.

Each detector is a regular expression whose group `s` is the secret. The trigrams that its matches must hold are derived
from the expression itself; a batch of texts is indexed by exactly those trigrams, and a detector runs only over texts
in the intersection of its postings. What it finds is a secret unless the value reads as a placeholder or as a
reference to where a secret is kept. Redaction replaces the characters of the secret alone, one for one, so that quotes,
line ends and offsets of the surrounding code stay as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.trigrams import TrigramIndex, candidates, grams_of, required_trigrams
from tesserine.llm.words import text_batches

#: The later pieces of a secret that is put together from several strings: redacted, but not a secret of their own.
CONTINUED = "continued"
_PIECE = re.compile(r"""["'`]([^"'`\n]+)["'`]""")
FLAGS = re.IGNORECASE | re.ASCII | re.MULTILINE

#: What names of secrets end in.
_NAME = (
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|cred(?:ential)?s?|(?:api|access|session|signing|secret|private|auth|encryption|crypt|"
    r"master|service|account|admin|client|deploy|license|webhook|storage|shared)[_\-]?key|bearer|auth)"
)
#: Between a name and its value: an assignment, a pair, an argument, a typed constant, or words.
_JOIN = r"""["'`]?\]?[ \t]*(?::[ \t]*(?:&(?:'static )?str|string|String|str|char\*?)[ \t]*=|:=|=>|==?|:|,|[ \t]was\b|[ \t]is\b)[ \t]*(?:String::from\(|str\(|new[ \t]+String\(|Secret\(|b(?=["']))?[ \t]*"""

#: name -> (pattern, flags). Group s is the secret; group q, if any, its opening quote.
DETECTORS: dict[str, tuple[str, int]] = {
    "provider-token": (
        r"(?<![A-Za-z0-9])(?P<s>(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|(?:ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|"
        r"glpat-[A-Za-z0-9_\-]{18,}|(?:xoxa|xoxb|xoxp|xoxr|xoxs)-[A-Za-z0-9\-]{16,}|sk-(?:proj-|ant-|live-)?[A-Za-z0-9_\-]{20,}|"
        r"(?:sk_live_|sk_test_|rk_live_|rk_test_|pk_live_)[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{30,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|"
        r"pypi-[A-Za-z0-9_\-]{40,}|dop_v1_[0-9a-f]{40,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,})", re.ASCII | re.MULTILINE),
    "issued-token": (r"(?<![A-Za-z0-9_])(?P<s>[A-Za-z]{2,16}(?:_pat_|_tok_|_sec_|_key_|_sk_|_api_|_secret_|_token_)[A-Za-z0-9]{16,})(?![A-Za-z0-9_])", re.ASCII | re.MULTILINE),
    "signed-token": (r"(?<![A-Za-z0-9])(?P<s>eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})", re.ASCII | re.MULTILINE),
    "private-key": (
        r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?P<s>(?:(?!-----(?:BEGIN|END))[\s\S])*)", re.ASCII | re.MULTILINE),
    "url-login": (r"[a-z][a-z0-9+.\-]*://[^\s:/@\"'`<>]*:(?P<s>[^\s@/\"'`]+)@[A-Za-z0-9\[]", FLAGS),
    "connection-string": (r"""(?:^|[;"'`=\s,?&])(?:password|passwd|pwd)[ \t]*=[ \t]*(?P<s>[^;"'`\s&]+)(?=[;&])""", FLAGS),
    "login-argument": (r"""\b(?:curl|wget|http)\b[^\n]*?[ \t](?:-u|--user|--proxy-user)[ =]+["']?[^\s:"'`]+:(?P<s>[^\s"'`]+)""", FLAGS),
    "auth-header": (r"""(?:authorization|x-auth|x-auth-token|x-api-key|private-token)["'`]?[ \t]*[:=,][ \t]*["'`]?(?:(?:basic|bearer|token|digest)[ \t]+)?(?P<s>[^\s"'`]{6,})(?=["'`\s]|$)""", FLAGS),
    "quoted-value": (rf"""{_NAME}(?P<j>{_JOIN})(?P<q>["'`])(?P<s>[^"'`\n]+)(?P=q)(?P<more>(?:\s*[+.]?\s*(?P=q)[^"'`\n]+(?P=q))*)""", FLAGS),
    "bare-value": (rf"""{_NAME}(?P<j>["']?[ \t]*(?:=|:|[ \t]was[ \t])[ \t]*)(?P<s>[^\s"'`,;(){{}}\[\]<>]+)(?=`|[ \t]*(?:\r?$|\#|//|-->|\*/|,[ \t]*\r?$)|;[ \t]*\r?$)""", FLAGS),
    "login-note": (r"""\b(?:login|log-in|credentials?|account|user(?:name)?)\b[^\n:]{0,60}:[ \t]*[^\s/:"'`]+[ \t]*/[ \t]*(?P<s>[^\s"'`,;()<>/]+)""", FLAGS),
    "prose": (rf"""(?:temporary|temp|old|use|try|note)[: \t]+(?P<s>[^\s"'`,;()<>]{{8,}})[ \t]+(?:works|is|was|serves)[ \t]+(?:as|the)[ \t]+[A-Za-z0-9_\-]*{_NAME}\b""", FLAGS),
}

#: Whole values that stand for a secret, and beginnings of references to where one is kept.
_STANDIN = re.compile(
    r"<.*>|\[.*\]|\{.*\}|\(.*\)|%.*%|%\(.*\)s|@.*@|__.*__|\.\.\..*|\$\{?[A-Za-z_][A-Za-z0-9_]*\}?|[xX*.\-_?#0]+|null|none|nil|true|false|undefined|todo|tbd|n/?a|empty|string|secret|password|token|"
    r"(?:env|vault|file|ssm|kms|aws|gcp|azure|secretref|keyring|keychain|op|ref|arn|config|data)[:/].*|(?:process\.env|os\.environ|std::env|environment\.|system\.getenv|getenv|config\.|settings\.|secrets?\.|self\.|this\.|args\.).*",
    re.IGNORECASE | re.ASCII | re.DOTALL)
_STANDIN_WORDS = re.compile(r"(?:^|[^A-Za-z])(?:your|replace|redacted|placeholder|example|dummy|sample|insert|fixme|changeme|replaceme|removed|masked|hidden)(?:[^A-Za-z]|$)", re.IGNORECASE | re.ASCII)
_PUBLIC = re.compile(r"(?:ssh-(?:rsa|ed25519|dss)|ecdsa-sha2|sha(?:1|256|384|512)[\-:]|md5[\-:]|-----BEGIN (?:PUBLIC|CERTIFICATE)|https?://[^@]*$)", re.IGNORECASE)
#: Names that end like a secret's but only speak of secrets, without separators and in lower case.
_ABOUT = ("publickey", "hostkey", "knownkey", "maxtoken", "mintoken", "numtoken", "counttoken", "totaltoken", "nexttoken", "prevtoken",
          "pagetoken", "csrftoken", "stoptoken", "padtoken", "eostoken", "bypass", "compass", "publictoken")


def _only_about(text: str, start: int, end: int) -> bool:
    """Whether the whole name that ends at `end` is one that only speaks of secrets."""
    while start and (text[start - 1].isalnum() or text[start - 1] in "_-"):
        start -= 1
    return re.sub(r"[_\-]", "", text[start:end]).lower().endswith(_ABOUT)


def _mixed(v: str) -> bool:
    """Letters with digits: what generated secrets and made-up passwords have, and names and numbers do not."""
    if not any(map(str.isalpha, v)):
        return False
    turns = sum(a.isupper() != b.isupper() for a, b in zip(v, v[1:]) if a.isalpha() and b.isalpha())
    return any(map(str.isdigit, v)) or (len(v) >= 10 and v.isalpha() and turns >= len(v) / 3)


def _identifier_like(v: str) -> bool:
    """A dotted or snake-case name, a call or a number, as code has them where a value is not quoted."""
    return bool(re.fullmatch(r"[A-Za-z_]+(?:[._:\-]+[A-Za-z_]+)*\d{0,2}|[\d._,]+|0x[0-9a-fA-F]+|[A-Za-z]+\d{1,3}", v, re.ASCII))


def plausible(kind: str, value: str) -> bool:
    """Whether a value found by a detector is a literal secret."""
    if kind == "private-key":
        return True
    v = value.strip()
    if kind in ("provider-token", "issued-token", "signed-token"):
        return len(set(v)) > 7 and not v.upper().endswith("EXAMPLE")
    if _STANDIN.fullmatch(v) or _STANDIN_WORDS.search(v) or _PUBLIC.match(v) or len(set(v)) <= 3:
        return False
    if kind in ("url-login", "connection-string", "login-argument"):
        return len(v) >= 3
    if kind in ("auth-header", "login-note"):
        return _mixed(v)
    if " " in v or len(v) < 6:
        return False
    return _mixed(v) and not _identifier_like(v)


@lru_cache(maxsize=1)
def _compiled():
    rules = {k: (re.compile(p, f), required_trigrams(p, f)) for k, (p, f) in DETECTORS.items()}
    free = [k for k, (_, q) in rules.items() if q is True]
    if free:
        raise ValueError(f"no trigram can be required for {free}")
    return rules, TrigramIndex(sorted(set().union(*(grams_of(q) for _, q in rules.values()))))


def _key_body(text: str, s: int, e: int) -> bool:
    """Whether what follows a key's header is key material, or the text ends there."""
    body = re.sub(r"[\s#/*;\\\"'+,!<>\-]+", "", text[s:e])
    return e == len(text) and not body or len(re.findall(r"[A-Za-z0-9+/=]", body)) >= 40


def secrets_in(text: str, kinds: list[str] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, detector) of the secrets in a text, in order, without overlaps (the longest of overlapping ones).

    The lines of a private key's body are one secret, which begins on the line of its header."""
    rules, _ = _compiled()
    found = []
    for kind in kinds or rules:
        for m in rules[kind][0].finditer(text):
            s, e = m.span("s")
            if kind == "private-key":
                if _key_body(text, s, e):
                    found.append((s, s, e, kind))
            elif kind == "quoted-value":
                more = [(s + (m.start("more") - s) + p.start(1), s + (m.start("more") - s) + p.end(1)) for p in _PIECE.finditer(m["more"])]
                if plausible(kind, "".join([m["s"], *(text[a:b] for a, b in more)])) and not _only_about(text, m.start(), m.start("j")):
                    found.append((s, s, e, kind))
                    found += [(a, a, b, CONTINUED) for a, b in more]
            elif plausible(kind, m["s"]) and not (kind == "bare-value" and _only_about(text, m.start(), m.start("j"))):
                found.append((s, s, e, kind))
    found.sort(key=lambda x: (x[1], -x[2]))
    out: list[tuple[int, int, str]] = []
    last = -1
    for _, s, e, kind in found:
        if s >= last:
            out.append((s, e, kind))
            last = e
    return out


def _scan(batches):
    """For Arrow batches with a text column: (row batch, texts, per text its secrets)."""
    rules, index = _compiled()
    for batch, texts in text_batches(batches):
        postings = index.postings(texts)
        chosen: dict[int, list[str]] = {}
        for kind, (_, query) in rules.items():
            for i in np.flatnonzero(index.matching(query, postings)).tolist():
                chosen.setdefault(i, []).append(kind)
        yield batch, texts, {i: s for i, kinds in sorted(chosen.items()) if (s := secrets_in(texts[i], kinds))}


def find_secrets(texts: DataFrame, id_column: str = "id", text: str = "text") -> DataFrame:
    """(id, line_no, start, length, detector): every secret. line_no counts from 1, split at `\\n`; start and length are
    in characters. A private key begins on the line of its header. Null and empty texts have none; a repeated row is
    reported as often as it comes in."""
    kind = texts.schema[id_column].dataType.simpleString()

    def find(batches):
        for batch, part, found in _scan(batches):
            rows = []
            for i, secrets in found.items():
                for s, e, k in secrets:
                    if k == CONTINUED:
                        continue
                    begin = part[i].rfind("-----BEGIN", 0, s) if k == "private-key" else s
                    rows.append((i, part[i].count("\n", 0, begin) + 1, s, e - s, k))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(x, pa.int32()) for x in cols[1:4]), pa.array(cols[4], pa.string())],
                ["id", "line_no", "start", "length", "detector"])

    rows = texts.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(find, f"id {kind}, line_no int, start int, length int, detector string").withColumnRenamed("id", id_column)


def find_secrets_indexed(texts: DataFrame, folder: str) -> DataFrame:
    """find_secrets of texts (id, text) through the index that trigrams.store_index wrote of them: postings are intersected
    first, and only the candidates' texts are looked at. For runs with new or few detectors over texts that stay; a single
    run over everything reads the texts anyway, and find_secrets does that without moving them."""
    rules, _ = _compiled()
    chosen = candidates(texts.sparkSession, folder, {k: q for k, (_, q) in rules.items()})

    def verify(batches):
        for batch in batches:
            rows = []
            for i, text, kinds in zip(*(c.to_pylist() for c in batch.columns)):
                for s, e, k in secrets_in(text, kinds):
                    if k != CONTINUED:
                        begin = text.rfind("-----BEGIN", 0, s) if k == "private-key" else s
                        rows.append((i, text.count("\n", 0, begin) + 1, s, e - s, k))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], ["id", "line_no", "start", "length", "detector"])

    rows = texts.where("text is not null").select("id", "text").join(chosen, "id").select("id", "text", "names")
    return rows.mapInArrow(verify, "id bigint, line_no int, start int, length int, detector string")


def redact(text: str, secrets: list[tuple[int, int, str]], mark: str = "*") -> str:
    """The text with the characters of the secrets replaced by `mark`; line ends, and comment marks and blanks at the
    beginning of the lines of a key body, stay."""
    out, at = [], 0
    for s, e, kind in secrets:
        out.append(text[at:s])
        out.append(re.sub(r"[A-Za-z0-9+/=:,]", mark, text[s:e]) if kind == "private-key" else re.sub(r"[^\r\n]", mark, text[s:e]))
        at = e
    return "".join([*out, text[at:]])


def redact_secrets(texts: DataFrame, id_column: str = "id", text: str = "text") -> DataFrame:
    """(id, text, n_secrets): every row with its secrets blanked, length and line structure unchanged."""
    kind = texts.schema[id_column].dataType.simpleString()

    def blank(batches):
        for batch, part, found in _scan(batches):
            clean = [t if i not in found else redact(t, found[i]) for i, t in enumerate(part)]
            n = [sum(k != CONTINUED for _, _, k in found.get(i, ())) for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(n, pa.int32())], ["id", "text", "n_secrets"])

    rows = texts.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(blank, f"id {kind}, text string, n_secrets int").withColumnRenamed("id", id_column)
