"""Language identification by word-first backoff.

A word of the model scores by its log frequency in each language. A word the model does not hold
falls back to the longest character n-grams of it that the model does hold, down to single
characters. A text's score is the sum over all its words.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, core, fold, session

#: Bounds of the model: characters of labelled text that a language is learned from, and entries it keeps.
TRAIN_CHARS, TOP_WORDS, TOP_GRAMS = 1_500_000, 50_000, 100_000
LONGEST = 5
UNKNOWN = "und"
#: Numerals that the regular expression's word characters hold beside digits and letters.
_NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isdecimal() and unicodedata.category(c)[0] != "L")
_RUN, _WORD = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{_NUMERALS}]+")


def words_of(text: str) -> list[str]:
    """Runs of letters of the lower-cased text. Numerals are rare, and the long class that names them slow, so it only sees runs that hold some."""
    runs = _RUN.findall(text.lower())
    if "".join(runs).isalpha():
        return runs
    return [w for run in runs for w in ([run] if run.isalpha() else _WORD.findall(run))]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between its border marks; single characters without the marks."""
    if n == 1:
        return list(word)
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray

    def backoff(self, word: str) -> np.ndarray:
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            known = [i for g in grams(word, n) if (i := self.grams.get(g)) is not None]
            if known:
                return self.gram_scores[known].mean(0)
        return np.zeros(len(self.languages), np.float32)


class Scorer:
    """Looks words up; keeps the scores of the words seen, up to a bound, after which it starts anew."""

    def __init__(self, model: Model, bound: int = 400_000):
        self.model, self.bound = model, bound
        self.reset()

    def reset(self) -> None:
        self.place = dict(self.model.words)
        self.scores = np.concatenate([self.model.word_scores, np.zeros((self.bound, len(self.model.languages)), np.float32)])
        self.used = len(self.model.words)

    def add(self, word: str) -> int:
        self.scores[self.used] = self.model.backoff(word)
        self.place[word] = self.used
        self.used += 1
        return self.used - 1

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        total = self.model.prior.astype(np.float64)
        for lo in range(0, len(words), 100_000):
            part = words[lo : lo + 100_000]
            if self.used + len(part) > len(self.scores):
                self.reset()
            get, add = self.place.get, self.add
            at = [i if (i := get(w)) is not None else add(w) for w in part]
            total += self.scores[at].sum(0, dtype=np.float64)
        best = int(np.argmax(total))
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def _scores(counts: list[dict[str, int]]) -> tuple[dict[str, int], np.ndarray]:
    """An index of all entries and their smoothed log relative frequencies by language."""
    index = {x: i for i, x in enumerate(sorted(set().union(*counts)))} if counts else {}
    table = np.zeros((len(index), len(counts)))
    for k, own in enumerate(counts):
        table[[index[x] for x in own], k] = list(own.values())
    total = table.sum(0, keepdims=True)
    return index, np.log((table + 0.5) / (total + 0.5 * max(len(index), 1))).astype(np.float32)


def train(docs: DataFrame, train_chars: int = TRAIN_CHARS, top_words: int = TOP_WORDS, top_grams: int = TOP_GRAMS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with a language: about `train_chars` characters of each, drawn by a hash of the id.

    Rows with a null or blank language, or a null id, are passed over. Of words, and of n-grams, each
    language keeps those seen twice or more, or all if it has no such, up to the `top` most frequent,
    ties in their own order. The model's tables hold (entries of all languages) x languages numbers.
    """
    bound_batches(session(docs))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("id IS NOT NULL AND text IS NOT NULL AND trim(lang) <> ''")
    sizes = {r["lang"]: (r["n"], r["chars"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    languages = sorted(sizes)
    span = 1 << 30
    if not languages:
        return Model([], np.zeros(0), {}, np.zeros((0, 0), np.float32), {}, np.zeros((0, 0), np.float32))
    limits = session(docs).createDataFrame([(k, int(span * min(1.0, train_chars / max(c, 1)))) for k, (_, c) in sizes.items()], "lang string, bar long")  # a row a language
    chosen = rows.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(span)) < F.col("bar")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.update((lang, w) for w in words_of(text))
            pieces: Counter = Counter()
            for (lang, w), c in words.items():
                for n in range(1, min(LONGEST, len(w) + 2) + 1):
                    for g in grams(w, n):
                        pieces[lang, g] += c
            keys = [*((k, "w", x, c) for (k, x), c in words.items()), *((k, "g", x, c) for (k, x), c in pieces.items())]
            cols = list(zip(*keys, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "kind", "entry", "n"])

    sums = chosen.mapInArrow(count, "lang string, kind string, entry string, n long").groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n"))
    found: dict[tuple[str, str], dict[str, int]] = {(k, kind): {} for k in languages for kind in "wg"}
    for r in sums.where("n > 1").toLocalIterator():  # bounded by train_chars a language
        found[r["lang"], r["kind"]][r["entry"]] = r["n"]
    bare = {k for k, own in found.items() if not own}
    for r in sums.where("n = 1").toLocalIterator() if bare else []:
        if (r["lang"], r["kind"]) in bare:
            found[r["lang"], r["kind"]][r["entry"]] = 1

    def best(kind: str, most: int) -> list[dict[str, int]]:
        return [dict(sorted(found[k, kind].items(), key=lambda x: (-x[1], x[0]))[:most]) for k in languages]

    n = np.array([sizes[k][0] for k in languages], float)
    return Model(languages, np.log(n / n.sum()), *_scores(best("w", top_words)), *_scores(best("g", top_grams)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score (the posterior of the prediction, 0 to 1) of every row's whole text.

    Null texts and texts without a letter are `und` with score 0; so is every text if the model has
    no language. Ties go to the first language in alphabetical order. Only the text is read.
    """
    bound_batches(session(docs))
    shared = session(docs).sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            got = [scorer(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], [id_col, "lang_pred", "score"])

    return core(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")


def language_scores(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Predictions for all documents by a model of those outside fold `held` of crc32(doc_id)."""
    model = train(docs.where(fold("doc_id", folds) != held))
    return identify(docs, model).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
