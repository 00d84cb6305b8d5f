"""Token counts by offset-mapped attribution.

A whole document is encoded once. Every token then has a character span, and the spans are joined
with the document's section intervals; a token that crosses a border goes to one section by an
explicit rule. Encoding sections one by one would give other tokens at their borders.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import bound_batches, core, local_tokenizer_path, session

TOKENIZER = "byte_bpe_50k.json"
RULES = ("majority", "first")


class Encoder:
    """The ids of a byte-level BPE file, by the faster of two libraries that agree on them.

    Texts that hold a special token's string go through the file's own library, so that its
    handling of such strings stays.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in content["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
        self.fast = tiktoken.Encoding("lectern", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, np.int64)
        for t, i in ranks.items():
            self.sizes[i] = len(t)
        for t, i in self.special.items():
            self.sizes[i] = len(t.encode())

    @cached_property
    def slow(self):
        """The file's own library, loaded only where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


@lru_cache(maxsize=2)
def encoder(name: str = TOKENIZER) -> Encoder:
    return Encoder(local_tokenizer_path(name))


def token_spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens. A character belongs to the token with its first byte; a token without any has an empty span."""
    ends = np.cumsum(sizes[ids])
    if not text.isascii():
        raw = np.frombuffer(text.encode(), np.uint8)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ends = chars[ends]
    return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def line_sections(text: str) -> np.ndarray:
    """Start and end of each line, its line break included; the sections cover the text without gaps."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    breaks = np.flatnonzero(raw == 10) + 1
    ends = breaks if len(breaks) and breaks[-1] == len(raw) else np.append(breaks, len(raw))
    if not len(raw):
        return np.zeros((0, 2), np.int64)
    return np.stack([np.concatenate([[0], ends[:-1]]), ends], 1).astype(np.int64)


def attribute(spans: tuple[np.ndarray, np.ndarray], sections: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token counts of sorted, disjoint sections that cover the text.

    rule "majority": a token goes to the section with most of its characters, the earlier one on a
    tie. rule "first": to the section with its first character. Returns, per section, the tokens
    given to it, those of them that cross a border, and the tokens that touch it.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    start, end = spans
    n = len(sections)
    if not n or not len(start):
        none = np.zeros(n, np.int64)
        return none, none, none
    borders = sections[:, 1]
    a = np.minimum(np.searchsorted(borders, start, "right"), n - 1)
    b = np.minimum(np.searchsorted(borders, np.maximum(end - 1, start), "right"), n - 1)
    owner = a.copy()
    crossing = np.flatnonzero(b > a)
    if rule == "majority":
        for i in crossing:
            lo = np.maximum(sections[a[i] : b[i] + 1, 0], start[i])
            hi = np.minimum(sections[a[i] : b[i] + 1, 1], end[i])
            owner[i] = a[i] + int(np.argmax(hi - lo))
    touched = np.bincount(a, minlength=n + 1)[:n]
    for i in crossing:
        touched[a[i] + 1 : b[i] + 1] += 1
    return np.bincount(owner, minlength=n)[:n], np.bincount(owner[crossing], minlength=n)[:n], touched


def section_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each line of each document.

    Returns doc_id, section (from 0), start and end (characters, end exclusive), n_tokens (allocated
    by `rule`), n_crossing (those that cross a border) and n_touching. Over a document, n_tokens sums
    to the tokens of the whole text. Null and empty texts have no section and no row; repeated rows
    each give their rows; a null id stays null.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bound_batches(session(docs))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            key, cols = [], [[], [], [], [], [], []]
            for row, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                sections = line_sections(text)
                given, crossing, touching = attribute(token_spans(text, enc(text), enc.sizes), sections, rule)
                key.append(np.full(len(sections), row))
                for c, x in zip(cols, (np.arange(len(sections)), sections[:, 0], sections[:, 1], given, crossing, touching), strict=True):
                    c.append(x)
            if key:
                ids = batch.column(0).take(pa.array(np.concatenate(key)))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols)],
                    [id_col, "section", "start", "end", "n_tokens", "n_crossing", "n_touching"],
                )

    return core(docs, id_col, text_col).mapInArrow(
        run, f"`{id_col}` {id_type}, section long, start long, end long, n_tokens long, n_crossing long, n_touching long"
    )
