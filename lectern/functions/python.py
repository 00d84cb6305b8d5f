"""Functions no built-in expresses, as Arrow-batched pandas UDFs.

Callers apply them to distinct values where values repeat.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from itertools import accumulate, groupby, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words before a full stop that do not end a sentence.
ABBREVIATIONS = {
    "eq", "eqs", "fig", "figs", "ref", "refs", "sec", "secs", "ch", "chap",
    "no", "nos", "vol", "vols", "pp", "p", "al", "et", "etc", "cf", "vs",
    "approx", "resp", "i.e", "e.g", "viz",
    "dr", "prof", "mr", "mrs", "ms", "st", "ca", "c",
    "km", "kpc", "pc", "au", "mev", "gev", "kev", "ev", "kg", "ms", "yr",
    "min", "sec", "hr", "deg",
}
#: Patterns of the headings of closing sections that carry no findings.
CLOSING = [
    r"acknowledge?ments?",
    r"acknowledgement",
    r"funding",
    r"author\s+contributions?",
    r"conflicts?\s+of\s+interest",
    r"competing\s+interests?",
    r"declaration\s+of\s+competing\s+interest",
    r"declarations?\s+of(?:\s+competing)?\s+interests?",
    r"disclosure(?:\s+statement)?",
    r"compliance\s+with\s+ethical\s+standards?",
    r"data\s+availability(?:\s+statement)?",
]
#: Patterns of what shows findings inside a section: tables, captions, display formulas.
FINDINGS = [
    r"<table\b",
    r"^\s*\|.*\|.*\|",
    r"^\s*TABLE\s+[IVXLC\d]+\b",
    r"^\s*FIG(?:URE)?\.?\s*[IVXLC\d]+\b",
    r"\$\$",
]


def plain_title(text: str | None) -> str:
    return re.sub("[^a-z0-9]+", " ", (text or "").lower()).strip()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; 0 if either is empty."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


def ratio_reaches(least: float):
    """Whether sequence_ratio() reaches `least`: its two upper bounds, which cost less, are asked first."""

    def one(a: str, b: str) -> bool:
        m = SequenceMatcher(None, a, b)
        return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least

    @F.pandas_udf(T.BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) if x and y else 0.0 >= least for x, y in zip(a, b, strict=True)], dtype=bool)

    return run


@F.pandas_udf(T.StringType())
def unicode_surface_key(name: pd.Series) -> pd.Series:
    """Case-folded, compatibility-normalised, without white space, hyphens and underscores."""
    return name.map(lambda x: re.sub(r"[\s\-_]+", "", unicodedata.normalize("NFKC", (x or "").casefold())))


@F.pandas_udf(T.StringType())
def slug_surname(name: pd.Series) -> pd.Series:
    """ASCII letters of the last name, accents dropped."""

    def one(x: str | None) -> str:
        words = (x or "").split(",")[0].split() if "," in (x or "") else (x or "").split()[-1:]
        flat = unicodedata.normalize("NFKD", "".join(words)).encode("ascii", "ignore").decode()
        return re.sub("[^a-z]", "", flat.lower())

    return name.map(one)


@F.pandas_udf(T.StringType())
def canonical_author(name: pd.Series) -> pd.Series:
    """'Given Family' from either order, run-together initials apart: 'Smith, J.A.' gives 'J. A. Smith'."""

    def one(x: str | None) -> str:
        s = " ".join((x or "").split())
        if s.count(",") == 1:
            family, given = (p.strip() for p in s.split(","))
            s = f"{given} {family}".strip()
        return re.sub(r"\b([A-Z])\.(?=[A-Z])", r"\1. ", s)

    return name.map(one)


_GAP = re.compile(r"\n\s*\n")
#: After a full stop, question or exclamation mark: closing quotes and brackets up to white space belong to what follows.
_FOLLOWED = r"""(?=["')\]]*\s)"""
_STOP = re.compile(r"[.!?]" + _FOLLOWED)
_AFTER_DIGIT = re.compile(r"\d\." + _FOLLOWED)
_AFTER_WORD = re.compile(r"(?<![A-Za-z.\-])[.\-]*([A-Za-z][A-Za-z.\-]*)\." + _FOLLOWED)


def sentence_ends(paragraph: str) -> list[int]:
    """Places after which a sentence ends: stops less those that follow a digit, an abbreviation or an initial."""
    inner = {m.end() for m in _AFTER_DIGIT.finditer(paragraph)}
    for m in _AFTER_WORD.finditer(paragraph):
        word = m[1].rstrip(".").lower()
        if len(word) == 1 or word in ABBREVIATIONS:
            inner.add(m.end())
    return sorted({m.end() for m in _STOP.finditer(paragraph)} - inner)


def sentences(text: str) -> list[str]:
    """Sentences in order; a blank line always ends one."""
    out = []
    for paragraph in map(str.strip, _GAP.split(text)):
        places = [0, *sentence_ends(paragraph), len(paragraph)]
        out += [s for a, b in pairwise(places) if (s := paragraph[a:b].strip())]
    return out


class FourCharacters:
    """Stands for a tokenizer where none is given: four characters a token."""

    @staticmethod
    def encode(text: str) -> list[str]:
        return [text[i : i + 4] for i in range(0, len(text), 4)]

    @staticmethod
    def decode(tokens: Sequence[str]) -> str:
        return "".join(tokens)

    @staticmethod
    def count(text: str) -> int:
        return estimate(text)


class TokenizerFile:
    """A tokenizer's JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)

    def encode(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def decode(self, tokens: Sequence[int]) -> str:
        return self.own.decode(tokens, skip_special_tokens=False)


@lru_cache(maxsize=2)
def tokenizer_of(path: str | None):
    return TokenizerFile(path) if path else FourCharacters()


def estimate(text: str) -> int:
    return (len(text) + 3) // 4


def pack_sentences(text: str, size: int = 2400, overlap: int = 200, tokenizer=FourCharacters) -> list[dict]:
    """Chunks of whole sentences of at most `size` tokens, counted on the joined text.

    A chunk is a range of sentence numbers. The next one starts with the last sentences of the one
    before whose sizes sum to `overlap` at most, one at least, never with all of it; it then holds one
    new sentence whatever their joint size. A sentence above `size` is cut into windows of tokens, and
    no sentence is carried across it.
    """
    parts = sentences(text)
    count = getattr(tokenizer, "count", lambda x: len(tokenizer.encode(x)))
    sizes = [count(s) for s in parts]
    stops = list(range(1, len(parts) + 1))  # behind the last sentence that a range from here may take
    for i in range(len(parts) - 2, -1, -1):
        if sizes[i + 1] <= size:
            stops[i] = stops[i + 1]
    spent = [0, *accumulate(sizes)]
    out: list[tuple[int, str]] = []

    def chunk(a: int, b: int) -> tuple[int, str]:
        content = " ".join(parts[a:b])
        return count(content), content

    first = new = 0
    while new < len(parts):
        if sizes[new] > size:
            tokens, step = tokenizer.encode(parts[new]), max(1, size - overlap)
            windows = range(0, max(len(tokens) - size, 0) + step, step)
            out += [(len(w), tokenizer.decode(w).strip()) for at in windows if (w := tokens[at : at + size])]
            first = new = new + 1
            continue
        stop = stops[new]
        # a longer range never counts less, so where the sizes point to, a few counts settle the end
        end = max(new + 1, min(bisect_left(spent, spent[first] + size + 1) - 1, stop))
        now = chunk(first, end)
        while end > new + 1 and now[0] > size:
            end, now = end - 1, chunk(first, end - 1)
        while end < stop and now[0] <= size and (longer := chunk(first, end + 1))[0] <= size:
            end, now = end + 1, longer
        out.append(now)
        if end < len(parts) and sizes[end] > size:
            first = end
        else:
            carry = min(bisect_left(spent, spent[end] - overlap), end - 1) if overlap > 0 else end
            first = max(carry, first + 1)
        new = end
    return [{"tokens": n, "content": content, "chunk_order_index": i} for i, (n, content) in enumerate(out)]


# data types as objects: strings would need a Spark context where executors import this module
CHUNKS = T.ArrayType(T.StructType([T.StructField("tokens", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("chunk_order_index", T.IntegerType())]))
SECTIONS = T.ArrayType(T.StructType([T.StructField("section_id", T.StringType()), T.StructField("content", T.StringType())]))


def chunker(size: int = 2400, overlap: int = 200, tokenizer: str | None = None):
    """Chunks of a text; `tokenizer` is the path of a tokenizer's file that all executors have."""

    @F.pandas_udf(CHUNKS)
    def run(text: pd.Series) -> pd.Series:
        own = tokenizer_of(tokenizer)
        return text.map(lambda x: pack_sentences(x or "", size, overlap, own))

    return run


def unfolded(df: DataFrame, text: str, parts: Callable[[str], list[dict]], kind: T.ArrayType, rows: int = 64) -> DataFrame:
    """df without its column `text`, a row for each part of it, with the parts' fields.

    A batch is worked through by so many rows, so a task holds the parts of these alone.
    """
    rest = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*rest, *kind.elementType.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.struct([(f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()) for f in kind.elementType.fields])
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                lists = [parts(x.as_py() or "") for x in some.column(text)]
                places = pa.array([i for i, own in enumerate(lists) for _ in own], pa.int64())
                made = pa.array([x for own in lists for x in own], kinds)
                yield pa.RecordBatch.from_arrays([*[some.column(f.name).take(places) for f in rest], *made.flatten()], names=schema.names)

    return df.mapInArrow(run, schema)


def chunked(df: DataFrame, text: str, size: int = 2400, overlap: int = 200, tokenizer: str | None = None) -> DataFrame:
    """df without its column `text`, a row for each chunk of it; `tokenizer` as for chunker()."""
    return unfolded(df, text, lambda x: pack_sentences(x, size, overlap, tokenizer_of(tokenizer)), CHUNKS)


def sectioned(df: DataFrame, text: str, size: int = 2400) -> DataFrame:
    """df without its column `text`, a row for each section of it."""
    return unfolded(df, text, lambda x: sections(x, size), SECTIONS)


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_sentences(text: pd.Series) -> pd.Series:
    return text.map(lambda x: sentences(x or ""))


def sections(text: str, size: int = 2400) -> list[dict]:
    """Blocks that start at Markdown headings, packed up to `size`; longer blocks go through the sentence chunker."""
    starts = sorted({0, *(m.start() for m in re.finditer(r"(?m)^#{1,6}\s", text))})
    blocks = [text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
    out, now = [], ""
    for block in filter(None, blocks):
        if estimate(block) > size:
            if now:
                out.append(now)
            now = ""
            out += [c["content"] for c in pack_sentences(block, size, 0)]
        elif now and estimate(f"{now}\n\n{block}") > size:
            out.append(now)
            now = block
        else:
            now = f"{now}\n\n{block}" if now else block
    if now:
        out.append(now)
    return [{"section_id": f"#s{i}" if len(out) > 1 else "", "content": c} for i, c in enumerate(out, 1)]


def sectioner(size: int = 2400):
    @F.pandas_udf(SECTIONS)
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: sections(x or "", size))

    return run


#: What makes a heading, and the section number that may stand before a closing heading's name.
HEADING, NUMBER = r"^\s{0,3}#{1,4}\s+\S", r"(?:[\dIVXLC]{1,6}[.)]?\s+)?"
_REFERENCES = re.compile(r"(?im)^\s{0,3}#{0,4}\s*(?:references|bibliography)\b")
_CLOSING = re.compile(r"(?im)^\s{0,3}#{1,4}\s*" + NUMBER + "(?:" + "|".join(CLOSING) + r")\b")
_BORDER = re.compile(f"(?im){HEADING}")
_FINDINGS = re.compile("(?im)" + "|".join(FINDINGS))


def without_references(text: str) -> str:
    """Cut at the first reference heading in the second half."""
    at = next((m.start() for m in _REFERENCES.finditer(text) if m.start() > len(text) * 0.5), None)
    return text if at is None else text[:at].rstrip()


def _joined(parts: list[str], gone: set[int]) -> str:
    """The sections that stay, a blank line where some went."""
    runs = [list(g) for _, g in groupby((i for i in range(len(parts)) if i not in gone), key=lambda i: sum(k < i for k in gone))]
    blocks = ["".join(parts[i] for i in run) for run in runs]
    return "\n\n".join(filter(None, (b.strip() for b in blocks))) if gone else "".join(blocks)


def without_closing(text: str) -> str:
    """A text without its closing sections: those headed as such that show no findings.

    The section that ends the text goes only from the second half of what is left of it. Sections go in order, and only as
    many of them as leave at least half: of the lengths after each, a later one that falls below half of an earlier one
    does not count.
    """
    borders = sorted({0, *(m.start() for pattern in (_BORDER, _CLOSING) for m in pattern.finditer(text))})
    parts = [text[a:b] for a, b in pairwise([*borders, len(text)])]
    idle = [i for i, p in enumerate(parts) if _CLOSING.match(p) and not _FINDINGS.search(p)]
    last = len(parts) - 1
    stages = [_joined(parts, set(idle[:k])) for k in range(len(idle) - (last in idle) + 1)]
    if last in idle and 2 * (len(stages[-1].rstrip()) - len(parts[last].strip())) > len(stages[-1]):
        stages.append(_joined(parts[:last], set(idle[:-1])).rstrip())
    return reduce(lambda later, earlier: earlier if 2 * len(later) < len(earlier) else later, reversed(stages))


@F.pandas_udf(T.StringType())
def clean_extract(text: pd.Series) -> pd.Series:
    """A paper's text without its references and closing sections."""
    return text.map(lambda x: without_closing(without_references(x)) if x else x)
