"""Spelling variants: words within one edit of each other, found by an even-partition pigeonhole join.

A word of length l is cut after l // 2 code points. One edit leaves one of the two segments whole, so
a word of length l or l + 1 that is one edit away has that segment at the same place, or shifted by one
behind an insertion. Where many words share a segment, as they do a frequent prefix, the rest of the
word is cut evenly once more by the same argument: a key is a segment and one half of what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import core, dropped, written

LETTERS = "[a-zÀ-ÿ]+"
SHORTEST, LEAST, TIMES, GARBLED = 7, 2, 10, 31


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, garbled: int = GARBLED) -> DataFrame:
    """word and n: letter runs of all texts in lower case (A to Z only), one code point deleted where `garbled` divides the run's checksum."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    runs = core(docs, id_col, text_col).toDF("id", "text").select("id", F.explode(F.regexp_extract_all(F.translate("text", upper, lower), F.lit(LETTERS), F.lit(0))).alias("run")).where(F.length("run") >= shortest)
    check = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", check.alias("h"), F.pmod("h", F.length("run")).cast("int").alias("at"))
    word = F.when(F.col("h") % garbled == 0, F.concat(F.substr("run", F.lit(1), F.col("at")), F.substr("run", F.col("at") + 2))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _parted(text: Column, own: Column, longer: int) -> list[tuple[Column, Column]]:
    """Segment and rest of a text, for both segments of an indexed text of length `own`; `longer` is 1 if this text has one code point more."""
    h = F.floor(own / 2).cast("int")
    one = F.lit(1)
    return [(F.substr(text, one, h), F.substr(text, h + 1)), (F.substr(text, h + 1 + longer), F.substr(text, one, h + longer))]


def _keys(word: Column, longer: int) -> Column:
    """The four keys under which a word is met by words of its length (longer = 0) or one shorter (1): hash, segment and half."""
    own = F.length(word) - longer
    out = []
    for seg, (text, rest) in enumerate(_parted(word, own, longer)):
        for half, (part, _) in enumerate(_parted(rest, F.length(rest) - longer, longer)):
            out.append(F.struct(F.xxhash64(own, F.lit(seg), text, F.lit(half), part).alias("key"), F.lit(seg).alias("seg"), F.lit(half).alias("half"), F.lit(longer).alias("longer")))
    return F.array(*out)


def near_words(words: DataFrame) -> DataFrame:
    """a, na, b, nb: every pair of words (word, n) that one inserted, deleted or replaced code point parts, once.

    A candidate found under several keys counts under its first one only, so no shuffle removes doubles.
    """
    index = words.select("word", "n", F.inline(_keys(F.col("word"), 0))).select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    probe = words.select("word", "n", F.inline(F.concat(_keys(F.col("word"), 0), _keys(F.col("word"), 1)))).toDF("b", "nb", "key", "seg", "half", "longer")
    a, b, longer, own = F.col("a"), F.col("b"), F.col("longer"), F.length("a")

    def first_part(text: Column, size: Column) -> Column:
        return F.substr(text, F.lit(1), size)

    h = F.floor(own / 2).cast("int")
    rest_a = F.when(F.col("seg") == 0, F.substr(a, h + 1)).otherwise(first_part(a, h))
    rest_b = F.when(F.col("seg") == 0, F.substr(b, h + 1)).otherwise(first_part(b, h + longer))
    g = F.floor(F.length(rest_a) / 2).cast("int")
    first_segment = (F.col("seg") == 0) | (first_part(a, h) != first_part(b, h))
    first_half = (F.col("half") == 0) | (first_part(rest_a, g) != first_part(rest_b, g))
    fits = (F.length("b") == own + longer) & ((longer == 1) | (a < b)) & first_segment & first_half
    return index.join(probe, "key").where(fits & (F.levenshtein(a, b, 1) == 1)).select("a", "na", "b", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """word and the last form that is reached from it, by pointer jumping: the longest chain halves in every round."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        after = written(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = after.where("moved").limit(1).count()
        dropped(now)
        now = after
        if not moved:
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, garbled: int = GARBLED) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of at least `shortest` code points and `least` occurrences.

    A word's form is its near word of largest n, ties to the smallest in code-point order, if that n is
    at least `times` the word's own; root follows forms to the last. Counts along a chain grow by `times`,
    so no chain is longer than the digits of a count. Null and empty texts hold no word, a null id counts
    as an empty one, repeated rows count each, texts of any length are read whole; an empty table gives no
    row; other columns are ignored. Words are counted before the shuffle; a frequent word, segment or form
    costs no task more than the words that meet it.
    """
    if times <= 1:
        raise ValueError("times must exceed 1, else forms could go round in circles")
    words = written(counted(docs, id_col, text_col, shortest, least, garbled), "words")
    sides = near_words(words).select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    ruled = F.when(-F.col("best.m") >= times * F.col("n"), F.col("best"))
    judged = words.join(best, "word", "left").select("word", ruled["other"].alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-ruled["m"]).alias("form_n"))
    judged = written(judged, "forms")
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
