"""Files that were not written by hand: tool output, minified scripts, third-party copies, data saved as code.

Models of each language's names are trained over all chunks: what the characters of a name cost (trigram cross-entropy),
how names are spelt (shares of the naming styles), and how many different names a text of so many names has. Every chunk
is then measured once against its language's models, the measures are summed per file, and a file is *foreign* if its
names

* repeat as a template's do (few different ones for so many), or
* are spelt in styles that are not the language's.

What kind of file it is then follows from its shape: minified (very long lines of foreign or mangled names, whose
cross-entropy is above the language's own; minifiers leave the names of markup alone), data (mostly literals), or
generated. Further signals are learnt from the corpus, starting from these files:

* Banners: a beginning of a comment that stands in files of which many are foreign, by a confidence bound far above the
  share of foreign files, speaks for the other files that have it. No phrase of any generator is written down here.
* Third-party copies cannot be told by their names in these tables (see README). They are told by a header that names
  other authors, and by folders: those where many files have such a header speak for the others in them.

Literal data and lines of one shape are measured directly. A mention of these things in the middle of a comment, or a
name that merely sounds like them, is none of them.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm.trigrams import TrigramIndex, grams_of, required_trigrams
from tesserine.llm.words import mix, text_batches
from tesserine.sources.durable import keep

#: Character classes of names: 0 outside, a-z, digit, underscore.
_CLASSES = 29
CELLS = _CLASSES**3
#: Languages with models of their own; the rest share one (a bound on what is broadcast: 100 kB a language).
MAX_LANGUAGES = 64
OTHER = "other"
#: Naming styles: led by an underscore, snake_case, other with underscores, CAPITALS, Pascal, lower, camelCase.
STYLES = 7
#: Numbers of names by powers of two, for the number of different ones that is usual.
_SIZES = 24

LONG_LINE = 800
LONG_SHARE = 0.5
#: A file's names are foreign from such a distance of their styles from the language's (total variation, less what
#: chance brings about among so few names), or from so few different ones (log of the ratio to what is usual).
FOREIGN_STYLE = 0.33
FEW_NAMES = -0.55
#: Names in very long lines are mangled from this multiple of their language's mean cost.
MANGLED_COST = 1.0
#: Names that a file must have for a verdict on them.
LEAST_NAMES = 12
#: The share of lines of one shape from which a file counts as filled in from a template: chance repeats a shape more
#: easily among few lines, by about one line in sqrt(lines). Configuration, logs and notes repeat shapes by nature.
TEMPLATE_SHARE, PLAIN_TEMPLATE_SHARE = 0.38, 0.55
PLAIN_FILE = r"(?i)\.(?:ya?ml|json5?|toml|ini|conf|cfg|env|properties|log|txt|sh|md|rst)$"
DATA_SHARE = 0.3
#: Comment beginnings and folders are learnt if the lower confidence bound of their share of seeds reaches this.
LEARNT_SHARE = 0.12
LEAST_SEEDS = 3

FLAGS = re.IGNORECASE | re.MULTILINE | re.ASCII
#: A header that names authors elsewhere.
LICENCE = (
    r"^[^\w\n]*(?:copyright (?:the|\(c\)|[0-9]{4})[^\n]{0,80}(?:authors|contributors)\b|\(c\) (?:the )?[^\n]{0,60}(?:authors|contributors)\b|"
    r"upstream (?:revision|version|commit)\b[^\n]{0,60}(?:imported|unchanged|without changes)|(?:taken over|vendored|imported|copied verbatim) from\b)"
)
#: A comment line, up to its second word.
_OPENING = re.compile(r"^[^\S\n]*(?://|#(?!\[)|\*|/\*|<!--|--|>|;)[^\w\n]*([^\W\d_]+)[^\w\n]+([^\W\d_]+)", re.MULTILINE)
_COMMENT_LINE = re.compile(r"\s*(?:$|//|#|\*|/\*|<!--|--|;|\"\"\"|\'\'\')")
_QUOTED = re.compile(r"""\"[^\"\n]*\"|'[^'\n]*'|^[^\S\n]*(?://|#(?!\[)|\*|/\*|<!--|--)[^\n]*""", re.MULTILINE)
#: Literal data: numbers in rows, JSON objects, long strings without spaces.
_DATA = re.compile(
    r"""(?:(?:0x[0-9a-f]+|-?\d+(?:\.\d+)?)(?:[uUlLfF]{0,2})\s*,\s*){4,}(?:0x[0-9a-f]+|-?\d+(?:\.\d+)?)?|(?:\{\s*\\?"{1,2}\w+\\?"{1,2}\s*:[^{}\n]*\}\s*,?\s*){2,}|["'][A-Za-z0-9+/=\\]{40,}["']""",
    re.IGNORECASE | re.ASCII)
#: What every match of _DATA holds: the ends of two of its numbers and the start of a third, two objects, or a long string.
_DATA_HINT = re.compile(rb"""[0-9A-Fa-f][uUlLfF]{0,2}\s*,\s*-?\d[\w.]*\s*,\s*-?\d|\}\s*(?:,\s*)?\{|[A-Za-z0-9+/=\\]{40}""")

FEATURES = (
    "lines long, chars long, data_chars long, long_chars long, bits double, names long, tokens long, different double, styles array<double>, "
    "licence int, openings array<long>, shapes array<struct<shape:long,n:int>>"
)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per byte its name class and its shape symbol: 0 dropped, 1 name, else the byte itself."""
    names, shapes = np.zeros(256, np.int32), np.arange(256, dtype=np.uint64)
    for i in range(26):
        names[97 + i] = names[65 + i] = 1 + i
    names[48:58], names[95] = 27, 28
    word = (names > 0) | (np.arange(256) >= 128)
    shapes[word] = 1
    shapes[[9, 13, 32]] = 0
    return names, shapes


def _bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in a row, a line end after each, and where each one ends."""
    data = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))


def _trigrams(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all class trigrams that end in a name or just behind it, and where they end."""
    k = _tables()[0][b]
    at = np.flatnonzero((k[2:] > 0) | (k[1:-1] > 0)) + 2 if len(k) > 2 else np.zeros(0, np.int64)
    return (k[at - 2] * _CLASSES + k[at - 1]) * _CLASSES + k[at], at


def language_key(language: Column, path: Column) -> Column:
    """The language, or the file's extension where none is given."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1))
    return F.coalesce(F.lower(language), F.when(ext != "", ext), F.lit(OTHER))


class Model:
    """What is usual in one language."""

    def __init__(self, trigrams: np.ndarray, habits: np.ndarray):
        self.bits = _bits(trigrams)
        style, (n, logs) = habits[:STYLES], habits[STYLES:].reshape(2, _SIZES)
        self.style = style / max(1.0, style.sum())
        known = np.flatnonzero(n)
        self.different = np.interp(np.arange(_SIZES), known, logs[known] / n[known]) if len(known) else np.zeros(_SIZES)


def _names(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, style, hash) of every name outside of quotes and comment lines, as an array of three rows."""
    b, ends = _bytes([_QUOTED.sub(" ", t) if t else t for t in texts])
    k = _tables()[0][b] > 0
    heads = np.flatnonzero(k & ~np.concatenate([[False], k[:-1]])) if len(b) else np.zeros(0, np.int64)
    if not len(heads):
        return np.zeros((3, 0), np.uint64)
    last = np.flatnonzero(k & ~np.concatenate([k[1:], [False]]))
    upper, lower, score = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), b == 95
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (upper, lower, score)]
    up, low, under = (c[last + 1] - c[heads] for c in sums)
    first = b[heads]
    style = np.select(
        [first == 95, (under > 0) & (up == 0), under > 0, (low == 0) & (up > 1), (first >= 65) & (first <= 90), up == 0], np.arange(6), 6)
    place = (np.arange(len(b)) - np.repeat(np.append(0, heads), np.diff(np.concatenate([[0], heads, [len(b)]])))).astype(np.uint64)
    hashed = np.concatenate([[np.uint64(0)], np.cumsum(mix(b.astype(np.uint64) + (place << np.uint64(8))), dtype=np.uint64)])
    word = (up + low > 0) & ~((first >= 48) & (first <= 57))
    text = np.searchsorted(ends, heads, "right")
    return np.stack([text.astype(np.uint64), style.astype(np.uint64), mix(hashed[last + 1] - hashed[heads])])[:, word]


def _habits(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the counts of the styles of its names, and the numbers of names and of different ones."""
    text, style, name = _names(texts)
    text = text.astype(np.int64)
    styles = np.bincount(text * STYLES + style.astype(np.int64), minlength=len(texts) * STYLES).reshape(-1, STYLES)
    order = np.lexsort((name, text))
    t, n = text[order], name[order]
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1])
    return styles, styles.sum(axis=1), np.bincount(t[fresh], minlength=len(texts))


def train(chunks: DataFrame) -> dict[str, Model]:
    """The model of each language, from all chunks. Trigrams: the bits of each name character, and of the end of a name,
    given the two characters before it, over the language's own mean, with absolute smoothing; 1 is what a name of the
    language costs on average. chunks: (lang, text). Languages beyond the MAX_LANGUAGES most frequent ones, and texts
    without a language, share the model OTHER, made of their own counts."""
    habits = STYLES + 2 * _SIZES

    def count(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch, texts in text_batches(batches):
            langs, of = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            b, ends = _bytes(["\n\n" + (t or "") for t in texts])  # every text begins anew
            codes, at = _trigrams(b)
            trigrams = np.bincount(of[np.searchsorted(ends, at, "right")] * CELLS + codes, minlength=len(langs) * CELLS).reshape(-1, CELLS)
            styles, n, d = _habits(texts)
            size = np.minimum(np.log2(np.maximum(n, 1)).round().astype(int), _SIZES - 1)
            for i, lang in enumerate(langs.tolist()):
                mine = of == i
                some = mine & (n > 0)
                more = np.concatenate([styles[mine].sum(axis=0), np.bincount(size[some], minlength=_SIZES), np.bincount(size[some], np.log(d[some] / n[some]), _SIZES)])
                old = sums.get(lang, (np.zeros(CELLS, np.int64), np.zeros(habits)))
                sums[lang] = old[0] + trigrams[i], old[1] + more
        for lang, (trigrams, more) in sums.items():
            yield from rows([*(((lang, i), part) for i, part in enumerate(np.split(trigrams.astype(float), _CLASSES))), ((lang, _CLASSES), more)])

    def rows(parts):
        for (lang, i), part in parts:
            yield pa.RecordBatch.from_pydict({"lang": [lang], "slice": pa.array([i], pa.int32()), "counts": pa.array([part.astype("<f8").tobytes()], pa.binary())})

    def add(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for lang, i, c in zip(*(x.to_pylist() for x in b.columns)):
                sums[lang, i] = sums.get((lang, i), 0) + np.frombuffer(c, "<f8")
        yield from rows(sums.items())

    kind = "lang string, slice int, counts binary"
    frequent = chunks.where(F.col("lang") != OTHER).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    own = {lang: [np.zeros((_CLASSES, CELLS // _CLASSES)), np.zeros(habits)] for lang in [*(r["lang"] for r in frequent.collect()), OTHER]}
    lang = F.when(F.col("lang").isin(list(own)), F.col("lang")).otherwise(OTHER).alias("lang")
    summed = chunks.select(lang, "text").mapInArrow(count, kind).repartition("lang", "slice").mapInArrow(add, kind)
    for r in summed.collect():
        part = np.frombuffer(r["counts"], "<f8")
        if r["slice"] < _CLASSES:
            own[r["lang"]][0][r["slice"]] = part
        else:
            own[r["lang"]][1] = part
    return {lang: Model(t.reshape(-1), h) for lang, (t, h) in own.items()}


def _bits(counts: np.ndarray) -> np.ndarray:
    c = counts.reshape(-1, _CLASSES).astype(float) + 0.5
    bits = -np.log2(c / c.sum(axis=1, keepdims=True)).reshape(-1)
    mean = (bits * counts).sum() / max(1, counts.sum())
    return (bits / (mean or 1.0)).astype(np.float32)


@lru_cache(maxsize=1)
def _marks():
    query = required_trigrams(LICENCE, FLAGS)
    return re.compile(LICENCE, FLAGS), query, TrigramIndex(sorted(grams_of(query)))


def _per_text(values: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values by the text that holds their positions."""
    return np.bincount(np.searchsorted(ends, at, "right"), values, len(ends))


def measure(texts: list[str | None], langs: list[str], first_lines: list[int | None], models: dict[str, Model]) -> dict[str, list]:
    """FEATURES of each text."""
    b, ends = _bytes(texts)
    out: dict[str, list] = {"chars": np.diff(np.concatenate([[0], ends - 1])).tolist()}
    codes, at = _trigrams(b)
    owner = np.searchsorted(ends, at, "right")
    which = sorted(models)
    stacked = np.stack([models[m].bits for m in which])
    row = np.array([which.index(x if x in models else OTHER) for x in langs])
    # The mean cost of each name, so that short names weigh as much as long ones.
    k = _tables()[0][b]
    name = np.cumsum(np.concatenate([[False], (k[1:] > 0) & (k[:-1] == 0)]))[at]
    heads = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
    cost = np.add.reduceat(stacked[row[owner], codes], heads) / np.diff(np.append(heads, len(name))) if len(heads) else np.zeros(0)
    out["bits"] = np.bincount(owner[heads], cost, len(texts)).tolist()
    out["names"] = np.bincount(owner[heads], minlength=len(texts)).tolist()

    stops = np.flatnonzero(b == 10)
    starts = np.concatenate([[0], stops[:-1] + 1])
    symbols = _tables()[1][b]
    symbols[stops] = 0
    kept = np.flatnonzero(symbols)
    s = symbols[kept]
    line = np.searchsorted(stops, kept)
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != 1) | (s[:-1] != 1) | (line[1:] != line[:-1])
    kept, s, line = kept[fresh], s[fresh], line[fresh]
    heads = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(s)))
    place = (np.arange(len(s)) - np.repeat(heads, size)).astype(np.uint64)
    shape = np.add.reduceat(mix(s + mix(place + np.uint64(1))), heads) if len(heads) else np.zeros(0, np.uint64)
    second = np.where(size > 1, s[np.minimum(heads + 1, len(s) - 1)], 0) if len(heads) else s[:0]
    lead = s[heads]
    comment = ((lead == 47) & np.isin(second, (47, 42))) | ((lead == 35) & (second != 91)) | (lead == 42) | ((lead == 60) & (second == 33)) | (lead == 62)
    text_of = np.searchsorted(ends, starts[line[heads]], "right")
    length = (stops - starts)[line[heads]]
    code = ~comment
    out["lines"] = np.bincount(text_of[code], minlength=len(texts)).tolist()
    out["long_chars"] = np.bincount(text_of, length * (code & (length > LONG_LINE)), len(texts)).astype(np.int64).tolist()
    key = np.stack([text_of[code].astype(np.uint64), shape[code]])
    pairs, n = np.unique(key, axis=1, return_counts=True)
    bounds = np.searchsorted(pairs[0], np.arange(len(texts) + 1, dtype=np.uint64))
    out["shapes"] = [[{"shape": int(h), "n": int(c)} for h, c in zip(pairs[1, a:z].view(np.int64), n[a:z])] for a, z in zip(bounds, bounds[1:])]

    styles, n, d = _habits(texts)
    usual = np.stack([models[m].style for m in which])[row]
    size = np.log2(np.maximum(n, 1))
    ratio = np.array([np.interp(x, np.arange(_SIZES), models[which[r]].different) for x, r in zip(size, row)])
    out["tokens"] = n.tolist()
    out["different"] = (n * (np.log(np.maximum(d, 1) / np.maximum(n, 1)) - ratio)).tolist()
    out["styles"] = (styles - n[:, None] * usual).tolist()
    out["openings"] = [_openings(t) for t in texts]
    pattern, query, index = _marks()
    out["licence"] = [int(bool(h and _in_header(pattern, t or "", f))) for h, t, f in zip(index.matching(query, index.postings(texts)), texts, first_lines)]
    data = b.tobytes()
    begin = np.concatenate([[0], ends[:-1]])
    out["data_chars"] = [
        sum(m.end() - m.start() for m in _DATA.finditer(t)) if t and _DATA_HINT.search(data, int(a), int(z)) else 0
        for t, a, z in zip(texts, begin, ends)
    ]
    return out


def _openings(text: str | None) -> list[int]:
    """Hashes of the first two words of the text's comment lines, each once."""
    found = sorted({f"{m[1]} {m[2]}" for m in _OPENING.finditer(text.lower())}) if text else []
    return [int.from_bytes(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for x in found]


def _in_header(pattern: re.Pattern, text: str, first_line: int | None) -> bool:
    """Whether the pattern begins in the comment lines that the file begins with."""
    if (first_line or 1) > 1:
        return False
    end = 0
    for line in text.splitlines(keepends=True):
        if not _COMMENT_LINE.match(line.rstrip("\r\n")):
            break
        end += len(line)
    m = pattern.search(text, 0, end)
    return bool(m)


_KEYS = ["project_id", "path"]


def chunk_measures(chunks: DataFrame) -> DataFrame:
    """FEATURES of every chunk of (id, project_id, path, language, line_start, text). A repeated chunk counts once; rows
    without project, path or text are left out."""
    rows = chunks.where("project_id is not null and path is not null and text is not null").select(
        language_key(F.col("language"), F.col("path")).alias("lang"), "text", "id", "project_id", "path", "line_start")
    models = rows.sparkSession.sparkContext.broadcast(train(rows))
    types = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()),
        "array<struct<shape:long,n:int>>": pa.list_(pa.struct([("shape", pa.int64()), ("n", pa.int32())]))}
    fields = [x.split() for x in FEATURES.split(", ")]

    def extract(batches):
        for batch, texts in text_batches(batches):
            f = measure(texts, batch.column(0).to_pylist(), batch.column(5).to_pylist(), models.value)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(4), *(pa.array(f[n], types[t]) for n, t in fields)], ["id", *_KEYS, *(n for n, _ in fields)])

    return rows.mapInArrow(extract, f"id long, project_id long, path string, {FEATURES}").dropDuplicates([*_KEYS, "id"])


def file_measures(measured: DataFrame) -> DataFrame:
    """Per file of chunk_measures the sums of the features and the number of lines of its commonest shape."""
    names = ["lines", "chars", "data_chars", "long_chars", "bits", "names", "tokens", "different"]
    # One pass: the sums ride on the row of shape null, the shape counts on their own rows.
    marker = F.struct(F.lit(None).cast("long").alias("shape"), F.lit(0).alias("n"))
    spelt = [F.col("styles")[i].alias(f"style{i}") for i in range(STYLES)]
    names += [f"style{i}" for i in range(STYLES)]
    spread = measured.select("*", *spelt).select(*_KEYS, *names, "licence", F.explode(F.concat(F.array(marker), "shapes")).alias("_s"))
    only = lambda c: F.when(F.col("_s.shape").isNull(), F.col(c))
    by_shape = spread.groupBy(*_KEYS, F.col("_s.shape").alias("shape")).agg(F.sum("_s.n").alias("n"), *(F.sum(only(c)).alias(c) for c in names), F.max(only("licence")).alias("licence"))
    files = by_shape.groupBy(*_KEYS).agg(F.max("n").alias("template_lines"), *(F.sum(c).alias(c) for c in names), F.max("licence").alias("licence"))
    away = sum((F.abs(f"style{i}") for i in range(STYLES)), F.lit(0.0)) / 2
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    n = F.greatest("tokens", F.lit(1))
    return files.select(
        *_KEYS, "lines", "chars", "tokens", "licence", part("template_lines", "lines").alias("template_share"), part("data_chars", "chars").alias("data_share"),
        part("long_chars", "chars").alias("long_share"), part("bits", "names").alias("name_cost"), part("different", "tokens").alias("diversity"),
        (away / n - 1 / F.sqrt(n)).alias("style_distance"))


def foreign_names() -> Column:
    """Whether the names of a file are not of the language's usual kind."""
    return (F.col("tokens") >= LEAST_NAMES) & ((F.col("style_distance") >= FOREIGN_STYLE) | (F.col("diversity") <= FEW_NAMES))


def learnt(marks: DataFrame, seeds: DataFrame, mark: str) -> DataFrame:
    """(project_id, path) of the files with a mark that speaks for them. marks: (project_id, path, mark), each once; seeds:
    the files known already. A mark is learnt by the lower end of the 95 % score interval of its share of seeds."""
    held = marks.join(seeds.select(*_KEYS, F.lit(1).alias("_seed")), _KEYS, "left")
    n, k, z = F.col("_n"), F.col("_k"), 1.96
    low = (k / n + z * z / (2 * n) - z * F.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    good = held.groupBy(mark).agg(F.count("*").alias("_n"), F.count("_seed").alias("_k")).where((low >= LEARNT_SHARE) & (k >= LEAST_SEEDS)).select(mark)
    return marks.join(good, mark, "left_semi").select(*_KEYS).distinct()


def folder_marks(files: DataFrame) -> DataFrame:
    """(project_id, path, folder): the parts of each file's folder and the pairs of neighbouring ones, numbers aside."""
    parts = F.split(F.regexp_replace(F.regexp_extract("path", "^(.*)/", 1), "[0-9]+", "0"), "/")
    rows = files.select(*_KEYS, parts.alias("_p"))
    both = F.concat("_p", F.transform(F.sequence(F.lit(1), F.size("_p") - 1, F.lit(1)), lambda i: F.concat_ws("/", F.get("_p", i - 1), F.get("_p", i))))
    marks = F.when(F.size("_p") > 1, both).otherwise(F.col("_p"))
    return rows.select(*_KEYS, F.explode(F.array_distinct(marks)).alias("folder")).where("folder <> ''")


def classify(chunks: DataFrame) -> DataFrame:
    """The files with their measures and kind (minified, data, generated, vendored; null: written by hand)."""
    measured = keep(chunk_measures(chunks), "chunk-measures")
    files = keep(file_measures(measured), "file-measures")
    plain = F.when(F.col("path").rlike(PLAIN_FILE), PLAIN_TEMPLATE_SHARE).otherwise(TEMPLATE_SHARE)
    template = (F.col("lines") > 1) & (F.col("template_share") >= plain + 1 / F.sqrt(F.greatest("lines", F.lit(1))) / 1.2)
    openings = measured.select(*_KEYS, F.explode("openings").alias("opening")).distinct()
    banner = learnt(openings, files.where(foreign_names()), "opening").withColumn("banner", F.lit(True))
    folder = learnt(folder_marks(files), files.where("licence = 1"), "folder").withColumn("folder", F.lit(True))
    names_kept = F.lower("path").rlike(r"\.(css|scss|less|html?|svg)$")
    mangled = foreign_names() | (F.col("name_cost") >= MANGLED_COST) | names_kept
    kind = (
        F.when(F.col("data_share") >= DATA_SHARE, "data")
        .when((F.col("long_share") >= LONG_SHARE) & mangled, "minified")
        .when(foreign_names(), "generated")
        .when((F.col("licence") == 1) | F.col("folder"), "vendored")
        .when(F.col("banner") | template, "generated")
    )
    joined = files.join(banner, _KEYS, "left").join(folder, _KEYS, "left")
    return joined.withColumn("foreign", foreign_names()).withColumn("template", template).withColumn("kind", kind)


def not_handwritten(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(project_id, path, kind) of the files that were not written by hand, each once. Files without chunks, and chunks
    of files that `files` does not hold, give no row."""
    known = files.where("project_id is not null and path is not null").select("project_id", "path").distinct()
    found = classify(chunks).where("kind is not null").select("project_id", "path", "kind")
    return found.join(known, ["project_id", "path"], "left_semi")
